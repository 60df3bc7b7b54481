"""Personal data: candidate spans, gradient boosting over them, calibrated thresholds. DataFrame functions and Spark ML only.

Base patterns find email, ip, card and phone; matches that pass their kind's test are always redacted. Looser generators propose more
spans, which may overlap: obfuscated addresses, defanged or spaced quads, cards in odd groups, telephone numbers without a country
code. Each candidate gets features of its format (length, digits, groups, separators) and of its context (what stands beside it, words
before it). None of them is a test of its digits or of its normal form.

There are no labelled spans, so labels are made from what is certain. In documents of a sample of at most about SAMPLE_DOCS, chosen by
hash, each base span is written anew in its own surroundings in the ways in which people hide such data (HIDDEN), and the candidate that the
generators propose at just that place is positive. Negative are the candidates that they propose for look-alikes put there instead (ALIKE:
sums, versions, part numbers, places), those that cross the place, and candidates of the documents themselves that touch no base span and
whose normal form fails its kind's test. Candidates that pass it are in neither class. Boosted trees are fitted on 7 of 10 documents; the
others calibrate, for each kind, the least score at which PRECISION of the candidates are positive; a kind that never gets there adds
nothing. The trees become one Catalyst expression, so scoring is part of the scan: no shuffle, no model service. An added span must also be
possible: its normal form passes its kind's test. One that touches a base span or a better added one gives way.

Positions come from splitting a text by the pattern that also lists its matches: pieces and matches alternate. Running values over a
text's spans come from scan(), in blocks, so that time is near linear in the number of spans. Patterns use possessive repeats where nothing
can be given back and don't try the inside of a run that they have seen, so long runs neither backtrack nor recurse.

Defined results: a null text is empty and has no spans. Documents without candidates have none. If a sample has no base span, nothing is
added to the base spans. Repeated rows are rows like any other; an empty table gives an empty result; other columns stay, but those named
base or added are replaced."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.tables import table
from tallyloom.session import materialize

#: Documents whose candidates the trees are fitted on, about.
SAMPLE_DOCS = 10_000
#: Most candidates of those that are fitted on, about; each kind has an equal share.
SAMPLE_CANDIDATES = 50_000
PRECISION = 0.98
TREES = 12
DEPTH = 3
CONTEXT = 24
KINDS = ("email", "ip", "card", "phone")

#: Spans that scan() goes through at a time.
BLOCK = 256

#: The base patterns. Repeats that nothing after them can use are possessive, and a run is entered only at its beginning or
#: where the match before ended; they match the same spans.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this has no match that passes its test; far cheaper to look for.
BASE_GATE = {"email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
#: A sentence's end and the next one's first word ("home. The") are no dot of an address.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:(?: ?[\[(]dot[\])] ?| dot )[A-Za-z0-9_%+-]{1,64}){0,3}(?: ?@ ?| ?[\[(]at[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot |\. (?=[a-z0-9]|[A-Z]{2,}+(?![a-z]))| ?\.)[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?: ?\. ?|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{3,6}(?:[ ._/-]{1,3}[0-9]{2,6}){2,5}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
#: Each is a necessary condition of its pattern.
LOOSE_GATE = {
    "email": r"(?:@ ?|[\[(]at[\])] ?| at )[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?| dot | ?\. ?)[A-Za-z0-9-]{2}",
    "ip": r"[0-9](?: ?\. ?|\[\.\]|\(\.\))[0-9]{1,3}(?: ?\. ?|\[\.\]|\(\.\))[0-9]",
    "card": r"[0-9][ ._/-]{1,3}[0-9]{2,6}[ ._/-]{1,3}[0-9]",
    "phone": r"[0-9]{3}(?:\) ?|[ .-])[0-9]{3}[ .-][0-9]{4}",
}
#: Words before a span that speak of its kind, and words that speak against all.
HINTS = {"email": r"(?i)mail|contact|write|reach|@", "ip": r"(?i)\bip\b|host|server|addr", "card": r"(?i)card|visa|master|amex|pay|credit", "phone": r"(?i)tel|phone|call|fax|mobile"}
AGAINST = r"(?i)\b(?:version|release|section|chapter|part|item|order|invoice|no|nr|id|v)\b[.:# ]*$"
FORMAT = ("length", "digits", "letters", "groups", "longest", "shortest", "spaces", "dots", "dashes", "round", "square", "marks", "at", "spoken", "dot_word")
CONTEXT_FEATURES = ("before_word", "after_word", "before_number", "after_number", "hint", "against", "quoted")
FEATURES = ("kind", *FORMAT, *CONTEXT_FEATURES)

#: Addresses that a base span s stands for: itself, without its digits, and of words w1, w2 beside it, of which a corpus's own fashion of addresses knows
#: nothing. Both classes are written of them alike.
ADDRESSES = ["s", "regexp_replace(s, '[0-9]', '')", "concat(w1, '.', w2, '@', w2, '.org')", "concat(w2, '@', w1, '.com')", "concat(w1, '_', left(d, 2), '@', w2, '.co.', left(w1, 2))"]

#: How a base span is hidden: by kind, expressions over its text s and its digits d.
HIDDEN = {
    "email": [
        "regexp_replace(replace(s, '@', ' [at] '), '[.](?=[^.]*$)', ' [dot] ')",
        "replace(s, '@', ' @ ')",
        "replace(s, '@', '(at)')",
        "replace(replace(s, '@', ' at '), '.', ' dot ')",
        "replace(replace(s, '@', '[at]'), '.', '[dot]')",
    ],
    "ip": ["replace(s, '.', '[.]')", "replace(s, '.', ' . ')", "replace(s, '.', '(.)')", "replace(s, '.', '. ')"],
    "card": [f"regexp_replace(d, '([0-9]{{4}})(?=[0-9])', '$1{mark}')" for mark in (".", "_", "/", " - ", "  ")],
    "phone": [f"regexp_replace(right(d, 10), '^([0-9]{{3}})([0-9]{{3}})([0-9]{{4}})$', '{form}')" for form in ("($1) $2-$3", "$1-$2-$3", "$1.$2.$3", "$1 $2 $3", "($1)$2-$3")],
}
#: Look-alikes that take a base span's place.
ALIKE = {
    "email": ["replace(s, '@', ' at ')", "concat(left(concat(d, '12'), 2), ' @ ', right(concat('34', d), 2), '.50')", "concat('home at ', regexp_replace(s, '[^A-Za-z]', ''), '. and so on')"],
    "ip": ["concat(replace(s, '.', '. '), '. 7')", "concat('version ', replace(s, '.', '. '))", "concat('1. ', replace(s, '.', '. '))", "concat(replace(s, '.', ' . '), '.12')"],
    "card": [f"regexp_replace(d, '{groups}(?=[0-9])', '{to}')" for groups, to in (("([0-9]{3})([0-9]{2})([0-9]{5})", "$1.$2.$3/"), ("([0-9]{3})([0-9]{3})([0-9]{4})", "$1-$2-$3-"), ("([0-9]{4})([0-9]{2})([0-9]{2})", "$1-$2-$3 "), ("([0-9]{5})", "$1 "))],
    "phone": [f"regexp_replace(right(d, 10), '^([0-9]{{3}})([0-9]{{3}})([0-9]{{4}})$', '{form}')" for form in ("$1-$2-$3-17", "order $1 $2 $3", "22.$1.$2.$3", "$1.$2.$3.9", "no. $1-$2-$3")],
}


def let(value: str, name: str, use: str) -> str:
    """SQL for use, in which name stands for value; value is computed once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def blocks(items: str, block: int = BLOCK) -> str:
    """SQL for an array of one item or more in arrays of block items each. (slice() would copy the whole array for each of them.)"""
    last = f"(size({items}) - 1)"
    return f"transform(sequence(0, CAST(floor({last} / {block}) AS INT)), k -> transform(sequence(k * {block}, least(k * {block} + {block - 1}, {last})), i -> {items}[i]))"


def scan(items: str, zero: str, state: str, out: str, block: int = BLOCK) -> str:
    """SQL for the integers out that come, with a new state, from s.state and each item x in turn. A fold copies all that it has collected
    at every step: so it collects integers only, and by blocks, and n items cost about n * block copies."""
    none = "CAST(array() AS ARRAY<INT>)"
    inner = f"aggregate(part, named_struct('state', acc.now.state, 'out', {none}), (s, x) -> named_struct('state', {state}, 'out', concat(s.out, array({out}))))"
    done = "concat(acc.done, array(acc.now.out))"
    begin = f"named_struct('now', named_struct('state', {zero}, 'out', {none}), 'done', CAST(array() AS ARRAY<ARRAY<INT>>))"
    return f"IF(size({items}) = 0, {none}, aggregate({blocks(items, block)}, {begin}, (acc, part) -> named_struct('now', {inner}, 'done', {done}), acc -> flatten({done})))"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """Whether the digits of text pass Luhn's test."""
    own = F.reverse(digits(text))
    total = F.reduce(
        F.sequence(F.lit(1), F.greatest(F.length(own), F.lit(1))),
        F.lit(0),
        lambda n, i: n + F.coalesce(own.substr(i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1) - F.when((i % 2 == 0) & (own.substr(i, F.lit(1)) >= "5"), 9).otherwise(0), F.lit(0)),
    )
    return total % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """Whether a match of a kind's base pattern counts."""
    n = F.length(digits(text))
    return {
        "email": F.lit(True),
        "ip": text.rlike(r"^0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?(?:\.0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])?){3}$"),
        "card": n.between(12, 19) & luhn(text),
        "phone": n.between(9, 15),
    }[kind]


def _listed(text: Column, pattern: str, gate: str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.rlike(gate), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


CANDIDATE = "struct<kind:int,start:int,end:int,s:string,before:string,after:string>"


def _placed(pieces: str, matches: str, kind: int) -> str:
    """SQL for the matches with places and what stands around them: piece i stands before match i, piece i + 1 after it."""
    end = "s.state + length(x.p) + length(x.m)"
    own = f"named_struct('kind', {kind}, 'start', e - length(x.m), 'end', e, 's', x.m, 'before', right(x.p, {CONTEXT}), 'after', left(x.q, {CONTEXT}))"
    zipped = f"transform({matches}, (m, i) -> named_struct('m', m, 'p', pieces[i], 'q', pieces[i + 1]))"
    told = let(pieces, "pieces", let(zipped, "found", f"zip_with(found, {scan('found', '0', end, end)}, (x, e) -> {own})"))
    return f"CAST(IF(size({matches}) = 0, array(), {told}) AS ARRAY<{CANDIDATE}>)"


def candidates(docs: DataFrame, text: str = "text", base: str = "base", more: str = "more") -> DataFrame:
    """docs with base (matches that pass their test) and more (loose ones): arrays of structs."""
    whole = F.coalesce(F.col(text), F.lit(""))
    named = {f"__{o}{k}": _listed(whole, p, g) for o, patterns, gates in (("b", BASE, BASE_GATE), ("l", LOOSE, LOOSE_GATE)) for k in KINDS for p, g in [(patterns[k], gates[k])]}
    found = docs.withColumns(named)
    name = f"`{text.replace('`', '``')}`"
    place = lambda o, patterns: {f"__p{o}{k}": F.expr(_placed(f"split(coalesce({name}, ''), r'{patterns[k]}', -1)", f"__{o}{k}", i)) for i, k in enumerate(KINDS)}
    placed = found.withColumns(place("b", BASE) | place("l", LOOSE)).drop(*named)
    tested = lambda k: F.filter(f"__pb{k}", lambda c: valid(k, c["s"]))
    return placed.withColumns({base: F.concat(*map(tested, KINDS)), more: F.concat(*[F.col(f"__pl{k}") for k in KINDS])}).drop(*[f"__p{o}{k}" for o in "bl" for k in KINDS])


def normal(kind: str, text: Column) -> Column:
    """A loose match in its kind's plain form."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(text, r" ?[\[(]at[\])] ?| at | ?@ ?", "@"), r" ?[\[(]dot[\])] ?| dot | ?\. ?", ".")
    if kind == "ip":
        return F.regexp_replace(text, r" ?\. ?|\[\.\]|\(\.\)", ".")
    return F.concat(F.lit("+1"), digits(text)) if kind == "phone" else digits(text)


def possible(c: Column) -> Column:
    """Whether a candidate's normal form is one of its kind: it matches the base pattern and passes its test."""
    out = F.lit(False)
    for i, kind in enumerate(KINDS):
        plain = normal(kind, c["s"])
        out = F.when(c["kind"] == i, plain.rlike(f"^(?:{BASE[kind]})$") & valid(kind, plain)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def features(c: Column) -> list[Column]:
    """FEATURES of a candidate, as doubles."""
    s, before, after = c["s"], c["before"], c["after"]
    count = lambda pattern: F.length(s) - F.length(F.regexp_replace(s, pattern, ""))
    runs = F.transform(F.regexp_extract_all(s, F.lit("[0-9A-Za-z]+"), F.lit(0)), lambda x: F.length(x))
    hint = F.lit(False)
    for i, kind in enumerate(KINDS):
        hint = F.when(c["kind"] == i, before.rlike(HINTS[kind])).otherwise(hint)
    form = [F.length(s), count("[0-9]"), count("[A-Za-z]"), F.size(runs), F.array_max(runs), F.array_min(runs), count(" "), count("[.]"), count("-"), count("[()]"), count(r"[\[\]]"), count("[_/]"), count("@"), s.rlike(r" at |[\[(]at[\])]"), s.rlike(r" dot |[\[(]dot[\])]|[\[(][.][\])]")]
    context = [before.rlike(r"[\p{L}\p{N}]$"), after.rlike(r"^[\p{L}\p{N}]"), before.rlike(r"[0-9][ ._/()-]{0,3}$"), after.rlike(r"^[ ._/()-]{0,3}[0-9]"), hint, before.rlike(AGAINST), before.rlike("[\"'=]$") | after.rlike("^[\"'=]")]
    return [F.coalesce(v.cast("double"), F.lit(0.0)) for v in [c["kind"], *form, *context]]


def _tree(node, at: Column) -> Column:
    """A fitted tree as an expression over an array of features."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(at, F.lit(split.featureIndex())) <= F.lit(float(split.threshold())), _tree(node.leftChild(), at)).otherwise(_tree(node.rightChild(), at))


@dataclass
class Model:
    """Trees with weights, and the least margin by kind."""

    trees: list
    weights: list[float]
    least: dict[int, float]

    def margin(self, at: Column) -> Column:
        out = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            out = out + F.lit(float(weight)) * _tree(tree._call_java("rootNode"), at)
        return out

    def chosen(self, c: Column, at: Column) -> Column:
        """The margin where it reaches its kind's threshold, else null."""
        floor = F.lit(float("inf"))
        for kind, value in self.least.items():
            floor = F.when(c["kind"] == kind, F.lit(value)).otherwise(floor)
        score = self.margin(at)
        return F.when(score >= floor, score)


def touches(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """(c, label, of) of candidates whose class is certain; of: a hash of the document's text. docs has distinct texts."""
    found = candidates(docs.select(F.col(text).alias("text")), "text").withColumn("of", F.xxhash64("text"))
    # base spans with one of each kind of rewriting, drawn by hash, in their own surroundings
    spans = found.select("of", F.explode("base").alias("b")).select("of", "b.*").withColumns({"d": digits(F.col("s")), "draw": F.pmod(F.xxhash64("of", "start", "s"), F.lit(60))})
    # words beside the span, else letters of its own
    letters = F.regexp_replace("s", "[^A-Za-z]", "")
    word = lambda of, pattern: F.lower(F.coalesce(F.nullif(F.regexp_extract(of, pattern, 1), F.lit("")), F.nullif(letters, F.lit("")), F.lit("name")))
    spans = spans.withColumns({"w1": word("before", "([A-Za-z]{3,12})[^A-Za-z]*$"), "w2": word("after", "([A-Za-z]{3,12})")})
    meant = F.get(F.array(*map(F.expr, ADDRESSES)), F.pmod(F.xxhash64("of", "start", "s", F.lit(1)), F.lit(len(ADDRESSES))).cast("int"))
    spans = spans.withColumn("s", F.when((F.col("kind") == 0) & meant.rlike(f"^(?:{BASE['email']})$"), meant).otherwise(F.col("s")))
    written_ = lambda forms: F.get(F.array(*map(F.expr, forms)), (F.col("draw") % len(forms)).cast("int"))
    as_kind = lambda ways: F.coalesce(*[F.when(F.col("kind") == i, written_(ways[k])) for i, k in enumerate(KINDS)])
    both = spans.select("of", "kind", "before", "after", F.explode(F.array(F.struct(as_kind(HIDDEN).alias("s"), F.lit(1.0).alias("label")), F.struct(as_kind(ALIKE).alias("s"), F.lit(0.0).alias("label")))).alias("w"))
    put = both.select("of", "kind", F.concat("before", "w.s", "after").alias("text"), F.length("before").alias("start"), (F.length("before") + F.length("w.s")).alias("end"), "w.label")
    here = candidates(put, "text")
    clear = lambda c: ~F.exists("base", lambda b: touches(b, c))
    place = F.struct("start", "end")
    exact = lambda c: (c["kind"] == F.col("kind")) & (c["start"] == F.col("start")) & (c["end"] == F.col("end"))
    planted = here.select("of", "label", F.explode(F.filter("more", lambda c: touches(c, place) & clear(c))).alias("c"), "kind", "start", "end").select("c", F.when(exact(F.col("c")), F.col("label")).otherwise(0.0).alias("label"), "of")
    natural = found.select("of", "base", F.explode("more").alias("c")).where(~F.exists("base", lambda b: touches(b, F.col("c"))) & ~possible(F.col("c"))).select("c", F.lit(0.0).alias("label"), "of")
    return planted.unionByName(natural)


def fit(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, precision: float = PRECISION, doc: str = "doc_id") -> Model | None:
    """Trees and thresholds from a sample of docs; None if it has no candidates of both labels."""
    total = docs.count()
    below = lambda draw, n, wanted: F.shiftrightunsigned(draw, 1) <= max(1, min((1 << 63) - 1, (wanted << 63) // max(n, 1)))
    part = docs.where(below(F.xxhash64(*[F.col(c) for c in (doc, text) if c in docs.columns]), total, sample_docs))
    c = F.col("c")
    rows = labelled(part.select(text).distinct(), text).select(*[f.alias(n) for f, n in zip(features(c), FEATURES, strict=True)], "label", F.pmod("of", F.lit(10)).alias("fold"), F.xxhash64("of", "c").alias("draw"))
    # bounded by the sample; dealt and sorted by hash, so that a rerun fits the same trees
    told = materialize(rows, "pii-candidates").repartition(4, "draw").sortWithinPartitions("draw", "label", *FEATURES)
    every = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(told).select("features", "kind", "label", "fold", "draw").persist()
    try:
        sizes = {(int(r["kind"]), r["label"]): r["n"] for r in every.groupBy("kind", "label").agg(F.count("*").alias("n")).collect()}
        wanted = F.lit(False)
        for (kind, label), n in sizes.items():
            wanted = F.when((F.col("kind") == kind) & (F.col("label") == label), below(F.col("draw"), n, SAMPLE_CANDIDATES // (2 * len(KINDS)))).otherwise(wanted)
        rows = every.where(wanted).drop("draw")
        seen = {r["label"]: r["n"] for r in rows.where("fold < 7").groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(seen) < 2:
            return None
        fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, minInstancesPerNode=3).fit(rows.where("fold < 7"))
        model = Model(list(fitted.trees), list(fitted.treeWeights), {})
        scored = rows.where("fold >= 7").select(F.col("kind").cast("int").alias("kind"), "label", model.margin(vector_to_array("features")).alias("margin"))
        bins = scored.groupBy("kind", "margin").agg(F.sum("label").alias("good"), F.count("*").alias("n")).orderBy("kind", F.desc("margin")).collect()
        for kind in range(len(KINDS)):
            good = n = 0.0
            for r in (r for r in bins if r.kind == kind):
                good, n = good + r.good, n + r.n
                if n >= 10 and good / n >= precision and r.margin > 0:
                    model.least[kind] = r.margin
        return model
    finally:
        every.unpersist()


SPAN = "struct<start:int,kind:int,end:int,score:double>"
SPANS = "array<struct<kind:int,start:int,end:int>>"


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))).cast(SPANS)


def apart(base: str, scored: str) -> Column:
    """Of the scored spans (a column) those that touch no base span (a column), and of touching ones the better, from the left: sweeps over
    sorted spans."""
    far = 2**31 - 1
    span = lambda kind, score: f"CAST(named_struct('start', c.start, 'kind', {kind}, 'end', c.end, 'score', {score}) AS {SPAN})"
    # kind -1 sorts before others, so a base span comes before a scored one of the same start
    mixed = f"array_sort(concat(transform({base}, c -> {span('-1', 'NULL')}), transform({scored}, c -> {span('c.kind', 'c.score')})))"
    # spans that begin after all base spans before them have ended, and end before the next ones begin
    after = scan("mixed", "0", "IF(x.kind = -1, greatest(s.state, x.end), s.state)", "IF(x.start >= s.state, 1, 0)")
    before = scan("turned", str(far), "IF(x.kind = -1, least(s.state, x.start), s.state)", "IF(x.end <= s.state, 1, 0)")
    free = let(mixed, "mixed", let(after, "after", let(f"reverse({let('reverse(mixed)', 'turned', before)})", "before", "filter(mixed, (c, i) -> c.kind >= 0 AND after[i] = 1 AND before[i] = 1)")))
    # the number of each span that stays is told by the next one that doesn't touch it, or by a last one beyond the text
    clear, seen = "x.start >= s.state.end", "'seen', s.state.seen + 1, 'at'"
    held = f"IF({clear} OR x.score > s.state.score, named_struct({seen}, s.state.seen + 1, 'end', x.end, 'score', x.score), named_struct({seen}, s.state.at, 'end', s.state.end, 'score', s.state.score))"
    stop = f"CAST(named_struct('start', {far}, 'kind', 0, 'end', {far}, 'score', 0) AS {SPAN})"
    told = let(f"concat(free, array({stop}))", "row", scan("row", "named_struct('seen', -1, 'at', -1, 'end', 0, 'score', 0D)", held, f"IF({clear}, s.state.at, -1)"))
    best = let(free, "free", f"transform(filter({told}, k -> k >= 0), k -> free[k])")
    return F.expr(f"CAST(IF(size({scored}) = 0, array(), {best}) AS ARRAY<{SPAN}>)")


def find(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """docs with base and added: arrays of struct(kind number, start, end) in code points, end exclusive. Base ones may overlap each
    other (of different kinds); added ones overlap none."""
    found = candidates(docs, text, "base", "__more")
    if model is None or not model.least:
        return found.withColumns({"base": _plain(F.col("base")), "added": F.array().cast(SPANS)}).drop("__more")
    fit_ = found.withColumn("__more", F.transform(F.filter("__more", possible), lambda c: F.struct(*[c[n].alias(n) for n in ("kind", "start", "end")], F.array(*features(c)).alias("f"))))
    scored = fit_.withColumn("__more", F.transform("__more", lambda c: F.struct(*[c[n].alias(n) for n in ("kind", "start", "end")], model.chosen(c, c["f"]).alias("score"))))
    held = scored.withColumn("__more", F.filter("__more", lambda c: c["score"].isNotNull()))
    return held.withColumns({"base": _plain(F.col("base")), "added": _plain(apart("base", "__more"))}).drop("__more")


def written(spans: Column) -> Column:
    """Spans as kind:start:end by start, then kind, comma-joined."""
    order = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(order, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def redact(text: str, *spans: str) -> Column:
    """The text (a column) with each span of the span columns as its kind in brackets; of overlapping ones, the first counts up to the end of
    the last."""
    name = f"`{text.replace('`', '``')}`"
    marks = f"array({', '.join(repr(f'[{k.upper()}]') for k in KINDS)})"
    order = f"array_sort(transform(concat({', '.join(spans)}), c -> named_struct('start', c.start, 'kind', c.kind, 'end', c.end)))"
    # runs of spans that overlap become one each: where, its mark, and where the run before ended
    reach = scan("spans", "0", "greatest(s.state, x.end)", "greatest(s.state, x.end)")
    first = "filter(sequence(0, size(spans) - 1), i -> spans[i].start >= coalesce(get(reach, i - 1), 0))"
    run = f"named_struct('start', spans[i].start, 'end', reach[coalesce(get(firsts, j + 1), size(spans)) - 1], 'mark', {marks}[spans[i].kind], 'from', coalesce(get(reach, i - 1), 0))"
    runs = let(order, "spans", let(reach, "reach", let(first, "firsts", f"transform(firsts, (i, j) -> {run})")))
    # a block's text is cut out once, its gaps are cut out of that: places in UTF-8 are found by counting
    gaps = "array_join(transform(own, c -> concat(substring(part, c.from - own[0].from + 1, c.start - c.from), c.mark)), '')"
    block = let(f"substring({name}, own[0].from + 1, element_at(own, -1).end - own[0].from)", "part", gaps)
    whole = f"concat(array_join(transform({blocks('runs')}, own -> {block}), ''), substring({name}, element_at(runs, -1).end + 1, length({name})))"
    return F.expr(f"IF({' + '.join(f'size({c})' for c in spans)} = 0, {name}, {let(runs, 'runs', whole)})")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, "text", fit(docs, "text"))
    n = lambda i: F.size(F.filter("base", lambda c: c["kind"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
    )
