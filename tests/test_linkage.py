"""Normalizing, matching, deduplicating and classifying lines."""

import difflib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rollbook.functions.similarity import PairScorer
from rollbook.operators import linkage, similar, tiles

ROLL = [("V001", "Jane", "Smith", "123 Main St", "90210", 1), ("V002", "John", "Doe", "456 Oak Ave", "90210", 2),
        ("V003", "Maria", "Garcia", "789 Pine Rd", "92501", 3), ("V004", "Bob", "Johnson", "321 Elm Dr", "90211", 4),
        ("V005", "Alice", "Brown", "555 Maple Blvd", "92502", 5)]


def roll(spark):
    return spark.createDataFrame(ROLL, "voter_id string, first_name string, last_name string, street_address string, zip_code string, roll_pos long")


def lines(spark, rows):
    data = [(1, i, n, a, "05/14/2026", True) for i, (n, a) in enumerate(rows, 1)]
    return spark.createDataFrame(data, "project_id long, line_number int, raw_name string, raw_address string, raw_date string, signature_present boolean")


def test_names_and_addresses(spark):
    got = {r.line_number: r for r in linkage.normalize_lines(lines(spark, [
        ("Jane Smith", "123 Main St, Springfield, CA 90210"), ("Smith, Jane", "123 Main St"), ("John Doe Jr.", "456 Oak Ave"),
        ("3 José Ñandú García", "12B N. Elm Street Apt 4, Los Angeles, CA 90001-1234"), ("Cher", ""),
        ("ﬁona ½ Kay", "123 Main St Springfield CA")])).collect()}
    assert (got[1].first_name, got[1].last_name, got[1].street, got[1].city, got[1].state, got[1].zip_code) == (
        "jane", "smith", "123 main st", "springfield", "ca", "90210")
    assert (got[2].first_name, got[2].last_name) == ("jane", "smith")
    assert got[3].last_name == "doe"
    assert (got[4].first_name, got[4].last_name, got[4].street, got[4].zip_code) == ("jose", "garcia", "12b n elm st", "90001 1234")
    assert (got[5].first_name, got[5].last_name, got[5].search_key) == ("", "cher", "cher")
    assert (got[6].first_name, got[6].city, got[6].state) == ("fiona", "springfield", "ca")
    assert got[1].search_key == "smith jane 123 main" and got[1].date == "05 14 2026"


def test_an_address_is_read_once(spark, monkeypatch):
    seen, read = [], linkage.with_address
    monkeypatch.setattr(linkage, "with_address", lambda df, raw: (seen.append(df), read(df, raw))[1])
    out = linkage.normalize_lines(lines(spark, [("Jane Smith", "123 Main St, Springfield, CA 90210")] * 40 + [("", "")] * 3 + [("Bob Ray", None)]))
    assert seen[0].count() == 2
    assert sorted(r["count"] for r in out.groupBy("street", "zip_code").count().collect()) == [4, 40]


def test_comparable_sheets_lists_every_pair(spark):
    from rollbook.operators import resheet
    sheets = lambda rows: spark.createDataFrame(rows, "project_id long, cause string, county string")
    new, old = [(11, "Parks", "Kern"), (12, "", "kern"), (13, "parks ", None)], [(1, "parks", "KERN"), (2, "roads", ""), (3, "", "yolo"), (4, "parks", "kern")]
    got = sorted(map(tuple, resheet.comparable_sheets(sheets(new), sheets(old)).collect()))
    assert got == [(11, 1), (11, 4), (12, 1), (12, 2), (12, 4), (13, 1), (13, 3), (13, 4)]


def test_match_finds_people_and_leaves_blank_lines(spark):
    n = linkage.normalize_lines(lines(spark, [("Jane Smith", "123 Main St Springfield CA"), ("Jane Smyth", "123 Main St Springfield CA"),
                                              ("Xyz Qwerty", "999 Nowhere Blvd Faketown ZZ"), ("", "")]))
    got = {r.line_number: r for r in linkage.match_lines(n, roll(spark)).collect()}
    assert got[1].voter_id == "V001" and got[1].match_confidence >= 85
    assert got[2].voter_id == "V001"
    assert got[3].match_confidence < 70
    assert got[4].voter_id is None
    empty = linkage.match_lines(n, roll(spark).where("false")).collect()
    assert len(empty) == 4 and all(r.voter_id is None for r in empty)


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_lcs_short_long_and_top_k_against_brute_force():
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    left, right = [word(rng.randint(0, 90)) for _ in range(60)], [word(rng.randint(1, 90)) for _ in range(300)]
    scorer = PairScorer(left, right)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(300), indexing="ij"))
    full = scorer.ratio(i, j).reshape(60, 300)
    assert [brute_lcs(left[k], right[k]) for k in range(60)] == list(scorer.lcs(np.arange(60), np.arange(60)))
    order = np.arange(300)[::-1].copy()
    gi, gj, _ = tiles.best_by_lcs(left, right, order, 5)
    want = {(q, p) for q in range(60) for p in sorted(range(300), key=lambda p: (-full[q, p], order[p]))[:5]}
    assert set(zip(gi, gj)) == want
    bound = tiles.Bound(left, right).rows(0, 60) * 100
    assert (bound + 1e-3 >= full).all()


def test_sequence_match_against_brute_force():
    rng = random.Random(9)
    pick = lambda w: rng.choice(w.split())
    person = lambda: (f"{pick('JANE JANET JOHN OMAR')} {pick('SMITH SMYTH DOE')}", f"{rng.randint(1, 40)} {pick('MAIN OAK')} STREET")
    q = pd.DataFrame([(*person(), pick("90001 90002")) for _ in range(30)] + [("JANE DOE", "", "")], columns=["name", "address", "zip"])
    p = pd.DataFrame([(k, *person(), pick("90001 90002")) for k in range(200)], columns=["pos", "name", "address", "zip"])
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    for weights, k, cutoff in (((0.55, 0.30, 0.15), 1, 0.0), ((0.6, 0.4, 0.0), 5, -1.0)):
        want = []
        for i, x in enumerate(q.itertuples()):
            scored = []
            for j, y in enumerate(p.itertuples()):
                s = ratio(x.name, y.name) * weights[0] + (ratio(x.address, y.address) if x.address else 0.0) * weights[1]
                s += (1.0 if weights[2] and x.zip and x.zip == y.zip else 0.0) * weights[2]
                if s > cutoff:
                    scored.append((-s, y.pos, i, j))
            want += [(i, j) for _, _, i, j in sorted(scored)[:k]]
        assert sorted((i, j) for i, j, _ in tiles.best_by_sequence(q, p, weights, k, cutoff)) == sorted(want)


def test_sequence_match_holds_no_table_of_queries_by_pool():
    import tracemalloc
    q = pd.DataFrame({"name": ["JANE DOE"] * 20000, "address": ["1 OAK"] * 20000, "zip": [""] * 20000})
    p = pd.DataFrame({"pos": range(6000), "name": [f"N{i}" for i in range(6000)], "address": ["2 ELM"] * 6000, "zip": [""] * 6000})
    tracemalloc.start()
    tiles.best_by_sequence(q, p, linkage.PACKET_WEIGHTS, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # one byte a pair would be 120 MB


def random_sheets(seed=3):
    rng = random.Random(seed)
    rows = []
    for p in range(12):
        for i in range(1, (150 if p == 0 else rng.randint(2, 20)) + 1):
            if rng.random() < 0.05:
                rows.append((p, i, "", "", "", "", "", ""))
                continue
            l, f = rng.choice(["smith", "smyth", "smit", "doe"]), rng.choice(["jane", "jame", "janet", "omar"])
            n, s = rng.choice(["12", "123", "124"]), rng.choice(["main", "maine", "oak"])
            rows.append((p, i, l, f, f"{n} {s} st", rng.choice(["la", "sf"]), rng.choice(["90001", "90002"]), f"{l} {f} {n} {s}"))
    return rows


def similarity(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return float(PairScorer([a], [b]).ratio(np.array([0]), np.array([0]))[0])


def test_duplicates_follow_the_sequential_rule_on_both_paths(spark):
    rows = random_sheets()
    df = spark.createDataFrame(rows, "project_id int, line_number int, last_name string, first_name string, street string, city string, zip_code string, search_key string")
    want = {}
    for p in {r[0] for r in rows}:
        keys, seen = {}, []
        for r in (r for r in rows if r[0] == p):
            key = "|".join([f"{r[2]}|{r[3]}", r[4], r[5], r[6]]) if r[2] and r[4] else ""
            dup = keys.get(key) if key else None
            if dup is None and r[7]:
                dup = next((n for t, n in seen if similarity(r[7], t) >= 92), None)
            if dup is None:
                keys.setdefault(key, r[1])
                seen.append((r[7], r[1]))
            want[p, r[1]] = dup
    for direct in (64, 1):  # 1 sends every sheet through the segment index
        got = {(r.project_id, r.line_number): r.duplicate_of_line for r in similar.find_duplicates(df, direct=direct).collect()}
        assert got == want


def test_status_policy(spark):
    cases = [(99.0, True, None, "approved"), (99.0, False, None, "review"), (72.0, True, None, "review"),
             (20.0, True, None, "rejected"), (99.0, True, 1, "duplicate")]
    df = spark.createDataFrame(cases, "c double, s boolean, d int, want string")
    assert df.where(linkage.classify(F.col("c"), F.col("s"), F.col("d")) != F.col("want")).count() == 0


@pytest.mark.parametrize("n", [6, 30, 450])
def test_sequence_ratios(n):
    """Against the standard library: pairs with edits, none in common, empty, and long ones with frequent characters."""
    from rollbook.functions.sequences import ratios
    r = random.Random(n)
    pairs = [("", ""), ("", "a"), ("a" * n, "a" * n)]
    for alphabet in ("ab", "abcde ", "abcdefghijklmnopqrstuvwxyz é𝄞"):
        for _ in range(60):
            a = "".join(r.choices(alphabet, k=r.randint(0, n)))
            b = list(a) if r.random() < 0.5 else r.choices(alphabet, k=r.randint(0, n))
            for _ in range(r.randint(0, 6) if b else 0):
                b[r.randrange(len(b))] = r.choice(alphabet + "x")
            pairs.append((a, "".join(b)))
    assert ratios(*map(list, zip(*pairs))).tolist() == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
