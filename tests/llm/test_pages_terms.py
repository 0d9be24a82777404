"""Page text, ranked search and source audit against plain versions."""

import html
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from rollbook.llm import audit, extract, layouts, queries, ranking

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ── page text ────────────────────────────────────────────────────────────────

@pytest.fixture(scope="module")
def model(spark):
    return extract.train(extract.labelled_pages(spark))


PAGES = [  # (html, main text)
    ("<html><body><nav><a href=/a>Home</a></nav><article><h1>Title &amp; more</h1><p>One<br>two  three.<p>Second <b>bold.</article>"
     "<footer>&copy; 2020 Site</footer></body></html>", "Title & more\nOne two three.\nSecond bold."),
    ("<body><div class=menu><ul><li><a href=1>News</a><li><a href=2>Sport</a></ul></div><div id=content><h1>A day at sea</h1>"
     "<p>The boat left early, and the wind was fair for most of the morning.</p><div class='ad-slot'>Buy now, cheap shoes for all.</div>"
     "<p>By noon it had turned, so we went home again without a single fish.</p></div><div id=comments><h3>2 comments</h3>"
     "<div class=comment><p>What a nice story, I had the very same day last year, but with rain.</p></div></div>"
     "<div class=sidebar><p>Subscribe to our newsletter for more.</p></div><div class=footer>All rights reserved.</div></body>",
     "A day at sea\nThe boat left early, and the wind was fair for most of the morning.\n"
     "By noon it had turned, so we went home again without a single fish."),
    ("<main><h1>List</h1><ul><li>First thing to know, in a few words.<li>Second thing to know, in a few more.</ul></main>"
     "<aside><h2>Related</h2><a href=x>Another page</a></aside><form><p>Your name</p><button>Send</button></form>",
     "List\nFirst thing to know, in a few words.\nSecond thing to know, in a few more."),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_written_pages(model, page, text):
    assert extract.main_text(page, model) == text


def test_unseen_layouts(model):
    """Pages of other seeds: words found and kept, and pages whose text is exactly right.

    Some hold an advert or a notice without any name amid the text: nothing tells these from it.
    """
    pages = [layouts.page(99_000_000 + i) for i in range(300)]
    found = [extract.main_text(h, model) for h, _ in pages]
    assert sum(a == b for a, (_, b) in zip(found, pages, strict=True)) >= 0.85 * len(pages)
    got, want = (Counter(w for t in x for w in t.split()) for x in (found, [t for _, t in pages]))
    both = sum((got & want).values())
    assert both >= 0.99 * sum(got.values())
    assert both >= 0.99 * sum(want.values())


def test_given_pages(spark, model):
    """What stands in the article of each given page, by a plain cut at its tags."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        want[r["page_id"]] = "\n".join(b for b in blocks if b)
    got = queries.QUERIES["op11_page_text"](spark, "/root/testdata/sf0.01").collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) and set(r.asDict()) == {"page_id", "url", "text", "n_chars"} for r in got)


def chain(rng, n):
    return [rng.uniform(-2, 2) for _ in range(n)], [rng.randrange(2) for _ in range(n)]


def total(scores, same, labels, steps, first):
    return first[labels[0]] + sum(s for s, y in zip(scores, labels, strict=True) if y) + sum(
        steps[same[t]][labels[t - 1]][labels[t]] for t in range(1, len(labels)))


def test_viterbi_against_all_labels():
    rng = random.Random(5)
    for n in (1, 2, 5, 9):
        scores, same = chain(rng, n)
        model = extract.Field({}, np.array([rng.uniform(-1, 1) for _ in range(8)]).reshape(2, 2, 2), np.array([0.3, -0.2]))
        best = max(itertools.product((0, 1), repeat=n), key=lambda y: total(scores, same, y, model.steps, model.first))
        assert tuple(extract.viterbi(scores, same, model)) == best
    assert extract.viterbi([], [], model) == []


def test_likelihood_against_all_labels_and_its_slopes():
    rng = random.Random(6)
    lengths, places = (1, 4, 6), 6
    scores, same, there, labels = (np.zeros((places, 3), t) for t in (float, int, bool, int))
    for i, n in enumerate(lengths):
        scores[:n, i], same[:n, i] = chain(rng, n)
        there[:n, i], labels[:n, i] = True, [rng.randrange(2) for _ in range(n)]
    x = np.array([rng.uniform(-1, 1) for _ in range(10)])
    value = lambda s, x: extract.likelihood(s, same, there, labels, x[:8].reshape(2, 2, 2), x[8:])
    plain = 0.0
    for i, n in enumerate(lengths):
        of = lambda y: total(scores[:n, i], same[:n, i], y, x[:8].reshape(2, 2, 2), x[8:])  # noqa: E731, B023
        plain += of(labels[:n, i]) - math.log(sum(math.exp(of(y)) for y in itertools.product((0, 1), repeat=n)))
    told, by_score, by_step, by_first = value(scores, x)
    assert told == pytest.approx(plain)
    for at in zip(*there.nonzero(), strict=True):
        moved = scores.copy()
        moved[at] += 1e-6
        assert (value(moved, x)[0] - told) / 1e-6 == pytest.approx(by_score[at], abs=1e-4)
    for k, slope in enumerate([*by_step.ravel(), *by_first]):
        moved = x.copy()
        moved[k] += 1e-6
        assert (value(scores, moved)[0] - told) / 1e-6 == pytest.approx(slope, abs=1e-4)


def test_pieces():
    text = lambda page: [p.text for p in extract.pieces(page)]
    assert text("a<!-- <p>no</p> -->b<script>'<p>'</script>c") == ["abc"]
    assert text("<ul><li>one<ul><li>two</ul><li>three</ul>") == ["one", "two", "three"]
    assert text("<p title='a>b'>x &lt; y &eacute;&nbsp;z</p>1 < 2 <") == ["x < y é z", "1 < 2 <"]
    assert text("<p a=\"open>still<p>text") == ["still", "text"]
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert [p.linked for p in extract.pieces("<p><a href=1>abc</a> de<p>fg")] == [3, 0]


def test_long_and_broken_pages(model):
    """Each within seconds: time follows the length."""
    for page in ("<div>" * 200_000 + "x", "<a <" * 100_000, "<p class='" * 50_000, "</div>" * 200_000, "<!-- " * 100_000,
                 "<svg>" * 100_000, "<div class=" + "ad " * 10 + ">" + "<p>some words here</p>" * 50_000, "&" * 300_000):
        extract.main_text(page, model)
    long = "<article>" + "".join(f"<p>Sentence number {i} of the long text, with some words.</p>" for i in range(50_000)) + "</article>"
    assert extract.main_text(long, model).count("\n") == 49_999


def test_odd_pages(spark, model):
    page = PAGES[0][0]
    rows = [(1, None, "u", "own"), (2, "", None, "own"), (3, " \n ", "u", None), (4, page, "u", "own"), (4, page, "u", "own"), (None, page, "u", "own")]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text string").selectExpr(
        "page_id", "html", "url", "text", "'own' as row", "named_struct('a b', 1) as `n chars`", "array(1) as n_chars")
    got = extract.extract(df, model)
    assert got.columns == ["page_id", "url", "row", "n chars", "n_chars", "text"]
    assert sorted((r["page_id"] or 0, r["text"]) for r in got.collect()) == sorted(
        (i or 0, PAGES[0][1] if h == page else "") for i, h, _, _ in rows)
    assert extract.extract(df.limit(0), model).count() == 0
    assert extract.train(spark.createDataFrame([], "html string, text string")).weights == {}
    assert extract.main_text(page, extract.train(spark.createDataFrame([(None, None)], "html string, text string"))) == ""


# ── ranked search ────────────────────────────────────────────────────────────

def plain_rank(docs, items, k):
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_all = sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    terms = defaultdict(set)
    for item, t in items:
        terms[item].update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, wanted in terms.items():
        found = []
        for i, c, n in held:
            m = 50 + 50 * n * len(held) // n_all
            found.append((sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                              for t in wanted if t in c), i))
        found = sorted(((s, i) for s, i in found if s > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank, i, s) for rank, (s, i) in enumerate(found[:k], 1)]
    return Counter(out)


def ranked(spark, docs, items, **how):
    got = ranking.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                       spark.createDataFrame(items, "item_id long, text string"), **how)
    return Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("how", [{"k": 5}, {"k": 50}, {"k": 3, "pairs": 40}])
def test_rank_against_plain(spark, how, monkeypatch):
    """Items of few and of over 64 terms, ties, documents of equal scores over several blocks and groups of items."""
    monkeypatch.setattr(ranking, "POSTINGS", 200)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)] + ["Ünder", "ß", "x1", "The"]
    docs = [(i, " ".join(rng.choices(words, [1 / (1 + j) for j in range(len(words))], k=rng.randint(0, 80)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(20)] + [(5000, " ".join(words) * 3), (None, docs[7][1])]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(12)] + [(50, " ".join(words[:140])), (51, docs[7][1])]
    assert ranked(spark, docs, items, **how) == plain_rank(docs, items, how["k"])


def test_masks_leave_groups_out(monkeypatch):
    """Documents whose mask cannot reach the k-th score are never scored."""
    rng = np.random.default_rng(2)
    ids = np.concatenate([np.zeros(3000, int), np.repeat([1, 2, 3], 20)])
    owner = np.concatenate([np.arange(3000), np.tile(np.arange(20), 3)])
    block = ranking.Block(ids, owner, np.where(ids > 0, 900, 10) + rng.integers(0, 5, len(ids)), 3000)
    seen = []
    score = ranking.scores
    monkeypatch.setattr(ranking, "scores", lambda b, lists, documents: (seen.extend(documents.tolist()), score(b, lists, documents))[1])
    best = ranking.search(block, np.arange(4), np.arange(3000), np.zeros(3000, bool), None, 10)
    assert set(seen) == set(range(20))
    assert best[0].tolist() == sorted(best[0].tolist(), reverse=True)


def test_rank_odd(spark, odd, none):
    items = spark.createDataFrame([(1, "one twice WORD"), (1, "text"), (2, None), (None, "ß é"), (3, "…")], "item_id long, text string")
    items = items.selectExpr("*", "1 as doc_id", "2 as at", "'x' as terms")
    got = Counter(tuple(r) for r in ranking.rank(odd, items).collect())
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got == plain_rank(docs, [(r["item_id"], r["text"]) for r in items.collect()], 50)
    assert ranking.rank(none, items).count() == ranking.rank(odd, items.limit(0)).count() == 0
    assert ranking.rank(none, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_rank_against_sql(spark):
    check_sql(spark, "op12_ranked_search")


def test_very_long_lengths():
    n = np.array([1, 10**9, 10**12])
    assert ranking.lengths(n, 10**9, 10**13).tolist() == [50 + 50 * int(x) * 10**9 // 10**13 for x in n]


# ── source audit ─────────────────────────────────────────────────────────────

def check_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall())


def plain_audit(docs, least, top):
    rows = [(lang or "", source or "", LETTERS.findall((t or "").translate(LOWER))) for lang, source, t in docs]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for r in own for t in set(r[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter(t for r in own if r[1] == s for t in r[2] if t in kept) for s in {r[1] for r in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        q = share(sum(counts.values(), Counter()))
        p = {s: share(c) for s, c in counts.items()}
        for s in p:
            for part, found, most in (("pair", [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s], None),
                                      ("term", [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]], top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, f, r) for r, (f, item) in enumerate(found[:most], 1)]
    return Counter(out)


def audited(docs, **how):
    return Counter(tuple(r) for r in audit.audit(docs, **how).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("stripe", "spread"), [(2, (1, 5)), (256, (1024, 10**6))])
def test_audit_against_plain(spark, monkeypatch, stripe, spread):
    """Small blocks, several stripes, terms that stand in several chunks of a document and several times in one."""
    monkeypatch.setattr(audit, "BLOCK_CHUNKS", 60)
    monkeypatch.setattr(audit, "STRIPE", stripe)
    monkeypatch.setattr(audit, "CELLS", 20)
    rng = random.Random(4)
    words = ["The", "the,", "the-The", "(a)", "É", "é1é", "été.", "x_y", "no break", "42", "…", "zz/zz/zz", "q"]
    docs = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ä", "c", None, "d"]),
             rng.choice([" ", "\n", "\t \x0b"]).join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(200)]
    docs += [("xx", "few", "seldom words"), ("xx", "none", None), ("yy", "alone", "")]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    monkeypatch.setattr(audit.term_counts, "__defaults__", spread)
    monkeypatch.setattr(audit, "ROW_CHUNKS", 7)
    monkeypatch.setattr(audit, "HELD", 10)
    assert audited(df, least=8, top=3) == plain_audit(docs, 8, 3)


def test_term_counts(spark):
    df = spark.createDataFrame([("en", "a", "Foo, foo bar-bar"), ("en", "a", "foo"), ("en", "b", "(FOO)")], "lang string, source string, text string")
    got = {(r["source"], r["term"]): (r["documents"], r["occurrences"]) for r in audit.term_counts(df).collect()}
    assert got == {("a", "foo"): (2, 3), ("a", "bar"): (1, 2), ("b", "foo"): (1, 1)}


def test_audit_odd(spark, odd, none):
    docs = [(r["lang"], r["source"], r["text"]) for r in odd.collect()]
    odd = odd.selectExpr("*", "1 as term", "2 as block", "3 as chunk", "4 as at", "5 as p", "6 as terms", "7 as value", "8 as item", "9 as part")
    assert audited(odd, least=1) == plain_audit(docs, 1, 50)
    assert audited(odd) == plain_audit(docs, 30, 50)
    assert audit.audit(none).count() == 0


def test_audit_against_sql(spark):
    check_sql(spark, "op13_source_audit")


def test_share_beyond_64_bits(spark):
    row = spark.sql("SELECT 5000000000000 AS c, 9000000000000 AS n, 7L AS v").select(audit.share("c", "n", "v")).first()
    assert row[0] == 1 + 10**9 * (5 * 10**12 + 5) // (9 * 10**12 + 35)
