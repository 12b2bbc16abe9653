"""The corpus pipeline against brute force: run() on documents with planted cases, and each stage on odd rows."""

import os
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadspark.llm import secrets
from tests.llm.test_operators import SCHEMA, WORD, words
from tests.llm.test_stated_cases import base_by_the_contract

SHARED = "this line of the page is on every one of them"


def table():
    item = words(40, 900, 5000)
    rows = [(i, f"{words(60 + i % 9, i, 3000)}" + (f"\n{SHARED}" if i < 70 else ""), "en", f"s{i % 2}" if i >= 70 else "s0", None) for i in range(200)]
    for i in range(12):  # near copies on both sides of the limit
        w = words(200, 777, 5000).split()
        for j in range(i):
            w[7 + 15 * j] = f"changed{i}x{j}"
        rows.append((300 + i, " ".join(w), "en", "s1", 9))
    rows += [(400, "start " + item + " " + words(30, 8, 3000), "en", "s1", 1), (401, " ".join(item.split()[:20]) + " " + words(30, 9, 3000), "en", "s1", 1), (None, "nobody " + item, "en", "s0", 1), (None, words(50, 10, 3000), "en", None, 1)]
    rows += [(500, words(20, 11, 3000) + ' password = "hunter22" ' + words(20, 12, 3000), "en", "s1", 1), (501, None, "en", "s1", 1), (502, "", None, None, 0), (503, "too few words", "en", "s1", 1)]
    rows += [(504, words(40, 13, 3000), "en", "s0", 1)] * 2 + [(505, ("again and again we say the same " * 20).strip(), "en", "s0", 1)]
    return rows, [(1, item), (2, None), (3, "")]


def brute(rows, items):
    """The rows that the first four stages keep: (doc_id, text, source)."""
    kept = []
    line = lambda x: " ".join(re.sub("[0-9]", "0", x.lower()).split())
    having = defaultdict(dict)
    for d, t, _, s, _ in rows:
        for x in {line(x) for x in (t or "").split("\n")} - {""}:
            having[s, x].setdefault(t, []).append(d)
    first = {k: min((d for ids in v.values() for d in ids if d is not None), default=None) for k, v in having.items() if len(v) > 50}
    for d, t, _, s, _ in rows:
        w = WORD.findall(t or "")
        win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {j for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        if len(w) < 10 or 100 * len(again) > 20 * len(w):
            continue
        left = "\n".join(x for x in t.split("\n") if (s, line(x)) not in first or first[s, line(x)] == d)
        if left == t or (len(WORD.findall(left)) >= 10 and 100 * len(WORD.findall(left)) >= 20 * len(w)):
            kept.append((d, left, s))
    low = lambda t: [x.lower() for x in WORD.findall(t)]
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    sets = {d: runs(low(t)) for d, t, _ in kept if d is not None}
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    kept = [*{(d, t, s) for d, t, s in kept if d is not None and label[d] == d}, *(r for r in kept if r[0] is None)]
    plain = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    want = [x for _, t in items if (x := runs(plain(t)))]
    kept = [r for r in kept if not any(100 * len(x & runs(plain(r[1]))) >= 80 * len(x) for x in want)]

    def redacted(t):
        out, end = [], 0
        for a, _, b in base_by_the_contract(t):
            if b > end:
                out += [t[end : max(a, end)], "[SECRET]" if a >= end else ""]
                end = b
        return "".join(out) + t[end:]

    return [(d, redacted(t), s) for d, t, s in kept]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows, items = table()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(os.path.join(path, "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(os.path.join(path, "benchmark.parquet"))
    return path


def test_run_equals_brute_force(spark, folder):
    rows, items = table()
    want = brute(rows, items)
    assert {300, 401, 500, 504} <= {d for d, _, _ in want} and not {301, 400, 501, 503, 505} & {d for d, _, _ in want} and sum(SHARED in t for _, t, _ in want) == 1
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter((r.doc_id, r.text, r.source) for r in docs.collect()) == Counter(want)
    size = {(d, t): len(WORD.findall(t)) for d, t, _ in want}
    sizes = defaultdict(int)
    for d, t, s in want:
        sizes[s] += size[d, t]
    got = corpus_pipeline.run(spark, folder).collect()
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, capped = {}, set()
    while True:
        free = {s for s in sizes if s not in capped}
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in free))
        target = {s: 3 * sizes[s] if s in capped else level * weight[s] for s in sizes}
        more = {s for s in free if target[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    taken = Counter()
    for r in got:
        assert (r.doc_id, r.text) in size and 0 < r.taken <= 3 * r.size == 3 * size[r.doc_id, r.text]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(size.values()) for s in sizes)


def test_stages_on_an_empty_table_and_on_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    clash = docs.withColumns({c: F.lit("mine") for c in ("size_", "h", "t", "w", "_d", "_t", "spans", "component_id", "item_id", "kept", "_drop")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        out = stage(spark, clash, folder)
        assert [c for c in out.columns if c in clash.columns] == clash.columns, name
        assert out.where("h = 'mine' and _d = 'mine'").count() == out.count(), name


def test_redaction_keeps_null_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in secrets.redact(docs).collect()} == {(1, None), (2, "")}
