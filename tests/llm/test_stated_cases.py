"""What the operators state about odd inputs, scale paths and learned parts: brute force, planted cases, clashing columns and empty tables."""

import math
import random
import re
import string
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadspark.llm import decontaminate, html_text, jaccard, language_model, mixing, pii, quality, secrets, substrings, token_counts
from tests.llm.test_operators import PAGE, SCHEMA, WORD, corpus, rows, words

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


OPERATORS = {
    "mix": lambda d: mixing.mix(d), "score": lambda d: language_model.score(d), "representatives": lambda d: jaccard.representatives(d).select("doc_id", "text"), "filtered": lambda d: quality.filter_documents(d).select("doc_id", "text"), "sanitised": lambda d: pii.sanitise(d).select("doc_id", "text"), "contained": lambda d: decontaminate.remove_contaminated(d, d.limit(0).select(F.col("doc_id").alias("item_id"), "text")).select("doc_id", "text"),
    "pii": lambda d: pii.report(d), "tokens": lambda d: token_counts.token_counts(d), "quality": lambda d: quality.judge(d), "substrings": lambda d: substrings.remove_repeats(d),
    "jaccard": lambda d: jaccard.linked(d), "secrets": lambda d: secrets.find(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_with_clashing_names_and_empty_tables(docs, name):
    clash = {c: F.lit("mine") for c in ("size", "taken", "h", "x", "d", "e", "q", "w", "t", "term", "n", "g", "c", "kept", "spans", "lines", "_t", "_d", "_n", "_key", "item_id", "component_id", "value", "kind", "_h", "_u", "_id", "_drop", "_spans", "_source", "_last", "_cut", "_whole", "_bucket", "copies", "first")}
    plain = sorted(map(str, rows(OPERATORS[name](docs))))
    other = OPERATORS[name](docs.withColumns(clash))
    names = OPERATORS[name](docs).columns
    assert sorted(str(tuple(r)) for r in other.select(*names).collect()) == plain
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_pages_table_empty_or_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "mine")], "page_id long, url string, html string, text string")
    assert html_text.main_text(pages).first().text.startswith("Head & line") and html_text.main_text(pages.limit(0)).count() == 0


ARTICLE = " ".join(f"word{i}," for i in range(60))


@pytest.mark.parametrize("page", [
    "<body><script>for(i=0;i<n;i++){} // don't</script><article>@</article></body>", "<body><script>var s='<!--';</script><article>@</article></body>", "<body><p title=it's>.</p><article>@</article></body>",
    "<body class='has-sidebar cookie-ok'><article>@</article></body>", "<body><div class='share-content'><article>@</article></div></body>", "<body><style>p:before{content:'<p>\"'}</style><article>@</article></body>",
    "<body><textarea><div class=ad></textarea><article>@</article></body>", "<body><title>never closed<article>@</article></body>", "<body><a href=\"x>y\" title='a\"b'></a><article>@</article></body>", "<body><!--> <article>@</article></body>",
    "<body><img alt=\"a > b\"><p data-x='></p>'></p><article>@</article></body>", "<body><SCRIPT>'</article>'</SCRIPT ><article>@</article></body>", "<article>@"])
def test_articles_survive_odd_pages(page):
    for weights in ({}, {"w:article": 2.0, "w:p": 1.0, "t:p": -0.2}):
        assert html_text.extract(page.replace("@", ARTICLE), weights, -0.2) in (ARTICLE, "never closed " + ARTICLE, ". " + ARTICLE)


@pytest.mark.parametrize("unit", ["<span>", "</b>", "<div class=x>", "<ul><li><div><span>", "<li></li>", "<p a", "<!--", "<a title='", "<title>", "a < b ", "x" * 20 + "=", "<p " + "y" * 20, "<script>", "&amp", "<![CDATA["])
def test_reading_a_page_takes_linear_time(unit):
    def took(n):
        page = ("<span>" * n + unit * n + "</i>" * n)[: 20 * n * len(unit)]
        begun = time.process_time()
        html_text.extract(page, {}, -0.2)
        return time.process_time() - begun

    took(2_000)
    assert took(40_000) < 40 * max(took(4_000), 0.02)


def test_a_page_of_megabytes():
    page = "<body><nav>menu</nav><article>" + "<p>some words of the text</p>" * 350_000 + "</article></body>"
    assert html_text.extract(page, {}, -0.2) == " ".join(["some words of the text"] * 350_000)


def test_the_run_of_tokens_is_the_best_of_all():
    r = random.Random(3)
    for _ in range(150):
        page = "".join(r.choice(["<p>", "</p>", "<div>", "</div>", "<a>x y", "</a>", " one", " two three", "<nav>no", "</nav>", "<br>"]) for _ in range(25))
        found = html_text.tokens(page)
        weights = {f: r.uniform(-1, 2) for _, f, _, _ in found if f[0] in "wa"}
        score = [min(-0.2, weights.get(f, -0.2)) if kind else len(t.split()) * weights.get(f, -1.0 if f[0] != "w" else 0.5) for kind, f, t, _ in found]
        sums = {(i, j): math.fsum(score[i:j]) for i in range(len(score)) for j in range(i + 1, len(score) + 1)}
        best = max(sums.values(), default=0.0)
        text = lambda i, j, found=found: " ".join("".join(" " if k and f[2:] not in html_text.INLINE else t if not k and f[0] != "x" else "" for k, f, t, _ in found[i:j]).split())
        allowed = {text(*ij) for ij, s in sums.items() if s > best - 1e-9} if best > 1e-9 else {""}
        assert html_text.extract(page, weights, -0.2) in allowed


def base_by_the_contract(text):
    assign = re.finditer(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24])


def test_base_secrets_equal_the_contract():
    r = random.Random(1)
    parts = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "API-KEY", "=", ":", " ", "  ", '"', "'", "abc", "abcdef12", "AKIA", "ABCDEFGHIJ0123456", "0123456789abcdef", "é", "\n", "x.y/z="]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 25)))
        assert [s for s in secrets.spans_of([text], secrets.Field())[0] if s[1] < 3] == base_by_the_contract(text)


def test_secrets_planted_outside_the_patterns_are_found_and_clean_documents_left_alone(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    field = secrets.fit(table)
    texts = [t.text for t in table.collect() if t.text and len(t.text.split(" ")) > 20]
    assert not any(k == 3 for spans in secrets.spans_of(texts, field) for _, k, _ in spans)
    r = random.Random(2)
    some = string.ascii_letters + string.digits
    make = {"ghp_": 36, "sk_live_": 24, "": 40, "xoxb-": 30}
    hits = n = 0
    for text in texts[:200]:
        for prefix, size in make.items():
            secret = prefix + "".join(r.choice(some) for _ in range(size))
            w = text.split(" ")
            w.insert(r.randrange(len(w)), secret)
            a = " ".join(w).index(secret)
            hits += any(k == 3 and x < a + len(secret) and a < b for x, k, b in secrets.spans_of([" ".join(w)], field)[0])
            n += 1
    assert hits > 0.95 * n


def test_spans_of_a_text_with_many_secrets_in_linear_time(spark):
    field = secrets.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    def took(n):
        r = random.Random(n)
        text = " ".join(("token = " if i % 2 else "word ") + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(30)) for i in range(n))
        begun = time.process_time()
        secrets.spans_of([text], field)
        secrets._labels(text, secrets.base_spans(text))
        return time.process_time() - begun

    assert took(16_000) < 25 * max(took(2_000), 0.02)


def test_language_model_against_deleted_interpolation_by_hand(spark):
    r = random.Random(4)
    table = [(i, " ".join(r.choice(["a", "b", "c", "d", "e", "rare%d" % i]) for _ in range(r.randint(0, 30)))) for i in range(150)]
    got = {x.doc_id: x.score for x in language_model.score(spark.createDataFrame(table, "doc_id long, text string").repartition(4), chunk_tokens=400, bucket_tokens=50).collect()}
    tokens = {d: [*WORD.findall(t), "</>"] for d, t in table}
    fold = {d: zlib.crc32(str(d).encode()) % 7 for d, _ in table}

    def counts(use):
        one, two = Counter(), Counter()
        for d in use:
            one["<>"] += 1
            one.update(tokens[d])
            two.update(zip(["<>", *tokens[d]], tokens[d]))
        return one, two

    bucket = lambda c: 1 + int(math.log2(c)) if c else 0
    one, two = counts([d for d in tokens if fold[d] not in (2, 5)])
    n_main = sum(c for w, c in one.items() if w != "<>")
    every, pairs = counts([d for d in tokens if fold[d] != 2])
    n, v = sum(c for w, c in every.items() if w != "<>"), len(every) - 1
    events = defaultdict(list)
    for d in tokens:
        if fold[d] == 5:
            for h, w in zip(["<>", *tokens[d]], tokens[d]):
                events[bucket(one[h])].append((two[h, w] / max(1, one[h]), one[w] / n_main, 1 / (v + 1)))
    weights = {b: [0.4, 0.4, 0.2] if b else [0.0, 0.7, 0.3] for b in range(48)}
    for _ in range(100):
        moved = 0.0
        for b, found in events.items():
            share = np.sum([np.array(weights[b]) * e / np.dot(weights[b], e) for e in found], axis=0) + 1e-6 * (np.array(weights[b]) > 0)
            moved = max(moved, np.abs(share / share.sum() - weights[b]).max())
            weights[b] = (share / share.sum()).tolist()
        if moved < 1e-3:
            break
    for b in range(1, 48):
        if b not in events and (low := [x for x in events if 0 < x < b]):
            weights[b] = weights[max(low)]
    p = lambda h, w: np.dot(weights[bucket(every[h])], (pairs[h, w] / max(1, every[h]), every[w] / n, 1 / (v + 1)))
    for d in tokens:
        assert got[d] == pytest.approx(sum(math.log10(p(h, w)) for h, w in zip(["<>", *tokens[d]], tokens[d])), rel=1e-6)
    for h in ("a", "c", "<>", "rare3"):  # over all words and one unknown
        assert sum(p(h, w) for w in every if w != "<>") + p(h, "never seen") == pytest.approx(1.0)


def luhn(digits):
    return sum((d * 2 - 9 if d > 4 else d * 2) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_personal_data_equals_the_contract(spark):
    r = random.Random(7)
    parts = ["4111111111111111", "4012 8888 8888 1881", "+1 (555) 555-0100", "+49.30.1234567", "12", "7", "-", " ", ".", "+", "(", ")", "a@b.co", "x", "1.2.3.4", "256.1.1.1", "5500-0000-0000-0004", "\n", "é"]
    table = [(i, "".join(r.choice(parts) for _ in range(r.randint(1, 14)))) for i in range(1500)]
    got = defaultdict(set)
    for x in pii.matches(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect():
        got[x.doc_id].add((x.kind, x.start, x.end))
    kinds = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for d, text in table:
        want = set()
        for kind, pattern in enumerate(kinds):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                if kind == 0 or (kind == 1 and all(int(x) < 256 for x in m[0].split("."))) or (kind == 2 and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == 3 and 10 <= len(digits) <= 15):
                    want.add((kind, m.start(), m.end()))
        assert got[d] == want, text


def test_quality_columns_and_verdicts_by_hand(spark):
    r = random.Random(9)
    lines = ["| see # all", "one two three four", "x", "", " \t", "same line * here", "say $5 & <b>"]
    table = [(i, "\n".join(r.choice(lines) + (f" w{i}" if r.random() < 0.6 else "") for _ in range(r.randint(0, 12))), f"h{i % 2}") for i in range(200)]
    table += [(500 + i, table[i][1], table[i][2]) for i in range(20)] + [(900, None, None), (901, "one two three four\n" * 3, None)]
    for limit in (500_000, 0):
        got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(table, "doc_id long, text string, source string"), min_line_docs=5, max_broadcast=limit).collect()}
        norm = lambda line: " ".join(re.sub("[0-9]", "0", line.lower()).split())
        having = defaultdict(dict)
        for d, t, s in table:
            for line in {norm(x) for x in (t or "").split("\n")} - {""}:
                having[s, line].setdefault(t, d)
        for d, t, s in table:
            t = t or ""
            split = [x for x in t.split("\n") if x.split()]
            gone = {x: len(x.split()) for x in map(norm, split) if len(having[s, x]) > 5 and min(having[s, x].values()) != d}
            counts = Counter(map(norm, split))
            removed = sum(n * counts[x] for x, n in gone.items())
            n = len(t.split())
            assert (got[d].n_symbols, got[d].n_dup_lines, got[d].removed_words) == (sum(t.count(c) for c in "#*$%&|<>"), len(split) - len(set(split)), removed)
            left = n - removed
            assert got[d].kept == (not got[d].base_failed and not (removed and (left < 10 or 100 * left < 20 * n)))


def test_rows_without_id_and_repeated_ids_are_decontaminated(spark):
    item = words(40, 5)
    table = [(None, "a " + item), (None, words(30, 1)), (1, item), (1, words(30, 2)), (2, None), (3, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    for most in (2_000_000, 0):
        left = decontaminate.remove_contaminated(docs, items, max_broadcast=most).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left) == sorted((d is None, d or 0, t or "") for d, t in (table[1], table[3], table[4], table[5]))
        assert [(r.doc_id, r.item_id) for r in decontaminate.contained(docs, items, max_broadcast=most).orderBy("doc_id").collect()] == [(None, 7), (1, 7)]


def test_the_mix_does_not_depend_on_its_buckets(docs):
    one, two = (sorted(map(str, rows(mixing.mix(docs, bucket_digits=n)))) for n in (1, 5))
    assert one == two


@pytest.mark.parametrize(("name", "kept"), [("site-footer", False), ("ad-slot", False), ("comment-list", False), ("cookie-notice", False), ("related-posts", False), ("post_comments", False), ("entry-header", True), ("content-no-sidebar", True), ("adventure", True), ("story-body", True)])
def test_parts_of_class_words_inside_an_article(name, kept):
    page = f"<body><article><p>{ARTICLE}</p><div class='{name}'>some words that follow here</div><p>{ARTICLE}</p></article></body>"
    for weights in ({}, {"w:article": 2.0, "w:p": 1.0, "w:div": 1.0, "t:p": -0.2, "t:div": -0.2}):
        assert html_text.extract(page, weights, -0.2) == " ".join([ARTICLE, *(["some words that follow here"] if kept else []), ARTICLE])
