"""Name search against all pairs, scored by the definition."""

import random
from difflib import SequenceMatcher, get_close_matches

import pytest

from tallyloom.operators import names as N
from tallyloom.operators import serving as V


def score(query, candidates):
    best, asked = 0.0, set(query.split())
    for c in filter(None, candidates):
        if c == query:
            return 1.0
        own, ratio = set(c.split()), SequenceMatcher(None, query, c).ratio()
        shared = len(own & asked) / len(own | asked)
        best = max(best, (0.88 if len(c) >= 4 else 0.74) if c in query or query in c else 0, 0.4 + 0.45 * shared if shared else 0, ratio * 0.65 if ratio >= N.CLOSE else 0)
    return round(best, 6)


@pytest.fixture(scope="module")
def products():
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("ABCDEIORST") for _ in range(draw.randint(1, 6)))
    out = []
    for k in range(150):
        name = " ".join(word() for _ in range(draw.randint(1, 3)))
        out.append((f"k{k:03}", name if k % 17 else "SAME NAME", draw.choice([None, "", str(draw.randint(10, 99999))]), [word() for _ in range(draw.randint(0, 3))], "extra"))
    return [*out, ("kx", None, None, [], "x"), ("ky", "", "", ["", "ÄÖ ß"], "x")]


QUERIES = ["SAME NAME", "same", "red bird", "TORSO 12", "a", "", None, "zzzz", "ÄÖ ß", "STAIR, CASE!", "12345", "rest a rest", "  same   name ", "B O D I E S"]


@pytest.mark.parametrize(("block", "part"), [(N.BLOCK, N.PART), (20, 4)])
def test_lists_equal_those_over_all_pairs(spark, products, block, part):
    known = spark.createDataFrame(products, "product_key string, normalized_product_name string, product_id_norm string, search_aliases_norm array<string>, score string")
    asked = V.asked_names(spark.createDataFrame([(q,) for q in QUERIES], "query string"))
    norms = {r.query: r.norm for r in asked.collect()}
    rows = N.ranked(asked, known, block=block, part=part).collect()
    got = {q: [(r.product_key, r.score) for r in sorted((r for r in rows if r["query"] == q), key=lambda r: r["rank"])] for q in norms}
    want = {}
    for q, norm in norms.items():
        every = [(-score(norm, [n, i, *a]), n or "", k) for k, n, i, a, _ in products]
        want[q] = [(k, -s) for s, _, k in sorted(x for x in every if x[0] < 0)[:5]]
    assert got == want
    close = {r.query: r.nearest for r in N.nearest(asked, known, block=block, part=part).collect()}
    titles = [n for _, n, *_ in products if n]
    assert close == {q: found for q, norm in norms.items() if (found := get_close_matches(norm, titles, n=5, cutoff=0.45))}
    if block == N.BLOCK:
        pairs = len(norms) * sum(len({n, i, *a} - {None, ""}) for _, n, i, a, _ in products)
        assert sum(r.scored for r in rows) < pairs / 4


def test_bound_is_never_below_the_ratio():
    draw = random.Random(8)
    for _ in range(300):
        a, b = ("".join(draw.choice("ABC 1Ä") for _ in range(draw.randint(1, 12))) for _ in range(2))
        assert 2 * N.Block([a]).common(b)[0] / (len(a) + len(b)) >= SequenceMatcher(None, a, b).ratio() - 1e-12


def test_answers_name_what_is_near(spark):
    product = lambda k, name, *alias: (k, name, k, name, k, list(alias))
    known = spark.createDataFrame([product("p1", "RED LAMP", "LAMP 7"), product("p2", "BLUE LAMP STAND"), product("p3", "TABLE"), product("p4", "CHAIR LEG", "LEG"), product("p5", "CHAIR ARM", "LEG")], "product_key string, product_family_name string, product_id_norm string, normalized_product_name string, x string, search_aliases_norm array<string>").drop("x").withColumn("product_id_norm", __import__("pyspark").sql.functions.upper("product_id_norm"))
    listed = spark.createDataFrame([("OLD CLOCK", "OLD CLOCK", "", [], "dropped")], "product_family_name string, normalized_product_name string, product_id_norm string, search_aliases_norm array<string>, reason_type string")
    asked = ["red lamp", "P2", "lamp 7", "leg", "my old clock please", "tabel", "redd lamp", "qqq", "", None]
    got = {r["query"]: (r.status, r["keys"], r.nearest) for r in V.answer(spark.createDataFrame([(q,) for q in asked], "query string"), known, listed).collect()}
    assert got["red lamp"] == ("resolved", ["p1"], []) and got["P2"] == ("resolved", ["p2"], []) and got["lamp 7"] == ("resolved", ["p1"], [])
    assert got["leg"] == ("ambiguous", ["p4", "p5"], []) and got["my old clock please"] == ("unavailable", ["OLD CLOCK"], [])
    assert got["tabel"][0] == "not_found" and got["tabel"][2][0] == "TABLE"
    assert got["redd lamp"][0] in ("resolved", "ambiguous") and got["redd lamp"][1][0] == "p1"
    assert got["qqq"] == ("not_found", [], []) == got[""] and len(got) == len(asked)
