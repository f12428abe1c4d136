"""Recall of the leak search against brute force, by item length and kind of change; run as a script it prints the table."""

import collections
import random
import re

import numpy as np

from wayloom.llm import decontaminate

LENGTHS = (12, 16, 24, 40, 64, 100, 160, 320)
KINDS = ("verbatim", "replaced 20 %", "replaced 35 %", "left out 25 %", "put in 30 %", "put in 60 %")


def edited(rng, words, kind, vocabulary):
    out = []
    for w in words:
        u = rng.random()
        if kind.startswith("replaced"):
            out.append(rng.choice(vocabulary) if u < (0.2 if "20" in kind else 0.35) else w)
        elif kind.startswith("left"):
            out += [w] if u >= 0.25 else []
        else:
            out += [rng.choice(vocabulary), w] if kind.startswith("put") and u < (0.3 if "30" in kind else 0.6) else [w]
    return out


def recall(spark, vocabulary, copies=8, seed=21):
    rng = random.Random(seed)
    items, docs, made = [], [], {}
    for n in LENGTHS:
        for kind in KINDS:
            for _ in range(copies):
                words = [rng.choice(vocabulary) for _ in range(n)]
                items.append((len(items), " ".join(words)))
                around = [rng.choice(vocabulary) for _ in range(300)]
                copy = edited(rng, words, kind, vocabulary)
                docs.append((len(docs), " ".join(around[:150] + copy + around[150:])))
                made[len(docs) - 1] = (n, kind)
    rows = spark.createDataFrame([(*d, "en", "a", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    # brute force: every document against every item, the whole document as the window
    number: dict[str, int] = {}
    code = lambda t: np.array([number.setdefault(w, len(number)) for w in t.lower().split()])
    texts = [code(t) for _, t in docs]
    hit, all_ = collections.Counter(), collections.Counter()
    for i, t in items:
        item = code(t)
        own = texts[i]
        answer = item[-min(decontaminate.ANSWER_WORDS, max(1, len(item) // 3)) :]
        if decontaminate.lcs(item.tolist(), own) >= 0.6 * len(item) and decontaminate.lcs(answer.tolist(), own) >= 0.5 * len(answer):
            all_[made[i]] += 1
            hit[made[i]] += (i, i) in got
    return hit, all_, got


def test_recall_by_length_and_change(spark):
    rng = random.Random(3)
    vocabulary = [f"{rng.choice('bcdfgst')}{rng.choice('aeiou')}{i}" for i in range(4000)]
    vocabulary += [w for i, w in enumerate(vocabulary[:400]) for _ in range(40 if i < 40 else 4)]  # a few frequent words
    hit, all_, got = recall(spark, vocabulary)
    for n in LENGTHS:
        assert sum(hit[n, k] for k in KINDS) >= 0.9 * sum(all_[n, k] for k in KINDS), (n, hit, all_)
    for k in KINDS:
        assert sum(hit[n, k] for n in LENGTHS) >= 0.9 * sum(all_[n, k] for n in LENGTHS), (k, hit, all_)
    assert all(a == b for a, b in got)


if __name__ == "__main__":
    import duckdb
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    sample = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where lang = 'en'").fetchall()
    words = [w.lower() for (t,) in sample for w in re.findall(r"\S+", t or "")]
    hit, all_, _ = recall(session, words, 12)
    for k in KINDS:
        print("|", k, "|", " | ".join(f"{hit[n, k]}/{all_[n, k]}" for n in LENGTHS), "|")
