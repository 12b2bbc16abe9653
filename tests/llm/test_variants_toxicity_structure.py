"""Spelling variants, toxicity and conversation structure: brute force, planted texts, odd rows and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspark.llm import spelling, structure, toxicity

ROWS = "conv_id long, turn long, role string, text string"


# --- conversation structure


def all_ways(rows):
    """The least (cost, audit) and its lines among all edits of rows [(role, text, fault)], tried one by one."""
    step, name = {"0": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    ways = {("0", ""): (0, ())}  # (state, audit): cost, lines
    for role, text, fault in rows:
        grown = {}
        for (state, audit), (cost, lines) in ways.items():
            for inserts in range(3):
                options = [("D", state, 4, ())]
                if fault not in ("blank", "duplicate"):
                    more = 3 if fault == "truncated" else 0
                    q = step[state]
                    options.append(("R", q, 3 + more, (f"{name[q]}:{text}",)))
                    if role[:1] == "s" and state == "0" or role[:1] == q and role[:1] in ("u", "a"):
                        options.append(("K", role[:1], more, (f"{role}:{text}",)))
                for edit, end, paid, line in options:
                    grown[(end, audit + edit)] = (cost + paid, lines + line)
                q = step[state]
                state, audit, cost, lines = q, audit + "I", cost + 3, (*lines, name[q] + ":")
        # the 60 cheapest of each state hold all optimal ones: from one state, what follows costs the same
        ways = {}
        for end in "0sua":
            cheapest = min((v[0] for k, v in grown.items() if k[0] == end), default=None)
            ways |= {k: v for k, v in grown.items() if k[0] == end and v[0] == cheapest}
    ends = []
    for (state, audit), (cost, lines) in ways.items():
        missing = {"0": "", "s": "ua", "u": "a", "a": ""}[state]
        ends.append((cost + 3 * len(missing), audit + "I" * len(missing), lines + tuple(name[c] + ":" for c in missing)))
    return min(ends)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        cut = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not cut else "duplicate" if (role, text) in seen else "truncated" if cut[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def conversations(seed=1, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, r.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), r.choice(["Yes.", "No?", "cut off", " ", "", f"line {r.randrange(9)}!", f"é {t}.\n"])))
    rows += [(900, None, "user", "Hello."), (900, None, "assistant", None), (900, 4, None, "Bye."), (900, 2, "user", "So."), (None, 1, "user", "No id."), (None, 2, "assistant", "None."), (901, 5, "user", "a" * 70 + "b."), (901, 5, "user", "a" * 70 + "c.")]
    return rows


def ordered(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2][:64].encode(), hashlib.md5(x[2].encode()).digest())
    return {c: sorted(v, key=key) for c, v in by.items()}


@pytest.mark.parametrize("block", [1024, 3])
def test_repair_equals_all_ways(spark, block):
    rows = conversations()
    got = {}
    for r in structure.repair(spark.createDataFrame(rows, ROWS).repartition(3), block).collect():
        got.setdefault(r.k, []).append(r)
    for c, own in ordered(rows).items():
        edits = sorted(got.pop("" if c is None else f"={c}"), key=lambda e: e.step)
        cost, audit, lines = all_ways(faults([x[1:] for x in own]))
        assert ("".join(e.edit for e in edits), sum(e.cost for e in edits)) == (audit, cost), own
        assert tuple(f"{e.role}:{e.text}" for e in edits if e.role is not None) == lines
        assert [e.fault for e in edits if e.edit != "I"] == [f for _, _, f in faults([x[1:] for x in own])]
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
    assert not got


def test_long_conversation_over_many_blocks_equals_one_block(spark):
    r = random.Random(4)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "cut", f"{t}.", ""])) for t in range(700)]
    one, many = (["".join(x.edit for x in sorted(structure.repair(spark.createDataFrame(rows, ROWS), b).collect(), key=lambda x: x.step))] for b in (1024, 5))
    assert one == many
    codes = bytes(r.randrange(12) for _ in range(200))
    whole = structure.total([structure.ROWS[c] for c in codes])
    halves = structure.total([structure.total([structure.ROWS[c] for c in part]) for part in (codes[:77], codes[77:])])
    assert whole == halves


def test_report_of_damaged_conversations(spark):
    rows = conversations(7, 120) + [(c, 1, "user", "Only one.") for c in range(2000, 2080)]
    got = {r.conv_id: r for r in structure.report(spark.createDataFrame(rows, ROWS).withColumn("k", F.lit(1)).withColumn("step", F.lit("x"))).collect()}
    kept = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if fate:
            row = (c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
            kept += [row] * (2 if fate == 3 else 1)
    left, gone = ordered(kept), 0
    for c in {r[0] for r in rows}:
        r, own = got.pop(c), left.get(c, [])
        judged = faults([x[1:] for x in own])
        cost, audit, lines = all_ways(judged)
        turns = {x[0] for x in own} - {None}
        n = Counter(f for _, _, f in judged)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        want = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert tuple(r)[1:] == want, (c, own)
        gone += not own
    assert not got and gone > 0
    assert structure.report(spark.createDataFrame([], ROWS)).count() == 0


# --- spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def vocabulary(seed=3, n=400):
    r = random.Random(seed)
    out = {}
    for _ in range(n):
        w = "".join(r.choice("abcdé") for _ in range(r.randrange(5, 9)))
        out[w] = r.randrange(3, 60)
        for _ in range(r.randrange(3)):
            i = r.randrange(len(w))
            out.setdefault(r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abcdé") + w[i:], w[:i] + r.choice("abcdé") + w[i + 1:]]), r.randrange(3, 20))
    return {w: c for w, c in out.items() if len(w) >= 5} | {"aaaaa": 3, "aaaaaa": 9, "aaaaaaa": 30}


@pytest.mark.parametrize("tile", [1000, 6])
def test_variants_equal_brute_force(spark, tile):
    words = vocabulary()
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").withColumn("base", F.lit(0)), tile=tile).collect()
    form = {}
    for w, n in words.items():
        near = [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = (best if best and words[best] >= 2 * n else None, len(near))
    assert len(got) == len(words)
    for r in got:
        root = r.word
        while form[root][0]:
            root = form[root][0]
        f = form[r.word][0]
        assert tuple(r) == (r.word, f, root, words[r.word], form[r.word][1], words[f] if f else None)


def test_runs_lose_a_letter_by_their_hash(spark):
    docs = [(i, " ".join(f"Strasse École{'abcdefghij'[i % 10]} naïvement×x 12 strasse" for _ in range(3))) for i in range(300)] + [(None, "strasse strasse strasse"), (1, None), (2, ""), (5, "Ünder " * 4)]
    want = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 5 and n >= 3}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.vocabulary(table, damage=97).collect()} == want
    assert any(len(w) < len("naïvement×x") and w.startswith("na") for w in want)
    assert {r.word for r in spelling.report(table).collect()} == set(want) and spelling.report(table.limit(0)).count() == 0


# --- toxicity


def texts(seed, n):
    """Texts of three languages; a tenth is toxic: a fiftieth of the words then begins with one of the language's two stems."""
    r = random.Random(seed)
    stems, rows, labels = {0: ("grollo", "vrutz"), 1: ("sképa", "dorné"), 2: ("ummaki", "tazzel")}, [], {}
    for i in range(n):
        kind, toxic = i % 3, r.random() < 0.1
        words = ["".join(r.choice(["ba", "ni", "lo", "te", "gro", "ské", "um"]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(60, 300))]
        if toxic:
            for _ in range(max(2, len(words) // 50)):
                words[r.randrange(len(words))] = r.choice(stems[kind]) + "".join(r.choice(["ba", "ni", "lo"]) for _ in range(r.randrange(3)))
        rows.append((i, " ".join(words)))
        labels[i] = int(toxic) if r.random() < 0.97 else 1 - int(toxic)
    return rows, labels


def test_planted_toxic_texts_are_found_and_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = texts(2, 1500)
    held = {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    docs = spark.createDataFrame([*rows, (None, "no id"), (7001, None), (7002, ""), (0, rows[0][1])], "doc_id long, text string").withColumn("label", F.lit(9)).withColumn("votes", F.lit("x"))
    given = [*((i, y) for i, y in labels.items()), (None, 1), (3, None)]
    got = toxicity.score(docs, spark.createDataFrame(given, "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.doc_id for r in got if r.held_out} == held
    clean = [i for i, t in rows if not re.search(r"\b(grollo|vrutz|sképa|dorné|ummaki|tazzel)", t)]
    marked = {r.doc_id for r in got if r.predicted and r.doc_id in held}
    toxic = held - set(clean)
    assert len(marked & toxic) >= 0.95 * len(toxic) and len(marked - toxic) <= 0.02 * len(held)
    assert {r.predicted for r in got if r.doc_id in (None, 7001, 7002)} == {0}
    other = toxicity.score(docs, spark.createDataFrame([(i, 1 - y if i in held else y) for i, y in given if i is not None and y is not None], "doc_id long, toxic int")).collect()
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in other) == sorted((r.doc_id or -1, round(r.score, 6)) for r in got)


def test_scores_without_labels_and_without_texts(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(docs, none).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), none).count() == 0
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, ones).collect()} == {1}


def test_label_model_finds_accuracies_and_counts_voters_that_repeat_each_other_once():
    r = np.random.default_rng(5)
    y = r.random(40_000) < 0.15
    right = [0.8, 0.7, 0.75]
    v = np.column_stack([np.where(y, r.random(len(y)) < a, r.random(len(y)) < 0.05) for a in right] + [r.random(len(y)) < 0.3 for _ in range(toxicity.VOTERS - 6)])
    v = np.column_stack([v, v[:, 0], v[:, 0], np.where(r.random(len(y)) < 0.02, ~v[:, 0], v[:, 0])])
    bits = (v.astype(int) << np.arange(toxicity.VOTERS)).sum(1)
    labels = np.where(r.random(len(y)) < 0.05, y.astype(int), -1)
    table = Counter(zip(bits.tolist(), labels.tolist(), strict=True))
    model = toxicity.LabelModel([k[0] for k in table], [k[1] for k in table], list(table.values()))
    assert abs(model.prior - 0.15) < 0.02 and model.right > 0.9 and model.wrong < 0.05
    # three voters that repeat the first add nothing: as likely as by the first alone
    only = np.zeros((1, toxicity.VOTERS))
    only[0, [0, -3, -2, -1]] = 1
    want = 0.15 * 0.8 * 0.3 * 0.25 / (0.15 * 0.8 * 0.3 * 0.25 + 0.85 * 0.05 * 0.95 * 0.95)
    assert abs(model.posterior(only, np.array([-1]))[0] - want) < 0.15
