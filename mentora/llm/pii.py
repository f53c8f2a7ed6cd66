"""Personal data by patterns and by bootstrapped contexts, with DataFrame functions alone.

Seeds are what the four base patterns find, and of the long hexadecimal keys in quotes after a name and a sign those
whose checksum is even, about half. The word before them, the two words before (a field's label and sign, say) and the
word after are lexical patterns; characters glued to an identifier, such as quotes, are passed over. A pattern's score is
the share of all its occurrences in the corpus that stand beside known identifiers, unjudged candidates counting half; an
instance's score is that of its best pattern. Both are computed in turn for a few rounds over the graph of patterns and
instances; candidates of looser forms whose score ends high enough are added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentora.llm.storage import Scratch

BASE_KINDS = ("email", "ip", "card", "phone")
#: Secrets (keys, access tokens, passwords) are only ever added spans.
KINDS = (*BASE_KINDS, "secret")
# The lookbehind keeps a scan from starting anew inside a run that has failed from its start, and possessive
# quantifiers from going back; the matches are those of the plain patterns.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET_SEED = r"(?<=[A-Za-z_]\x20?[=:]\x20?[\x22\x27])[0-9A-Fa-f]{32,}+(?=[\x22\x27])"
SECRET_SEED_PRESENT = r"[=:]\x20?[\x22\x27][0-9A-Fa-f]{32}"
#: A quick test that every text with a match passes.
PRESENT = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?)[A-Za-z0-9-]++)++",
    "card": BASE["card"],
    "phone": r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+(?![A-Za-z0-9_+/-])",
}
CANDIDATE_PRESENT = {"email": r"(?:at\]|at\)|at\})", "card": PRESENT["card"], "phone": r"[0-9][\x20.-][0-9]", "secret": r"[A-Za-z0-9_+/-]{16}"}
#: Keys whose crc32 is a multiple of this are seeds; contexts have to find the others.
SEED_SHARE = 2
ROUNDS = 3
MIN_SUPPORT = 5
MIN_SCORE = 0.6
#: Score of a candidate of which no pattern has said anything yet.
UNJUDGED = 0.5
#: Characters around a span that are searched for its words first; where they don't suffice, the whole text is.
NEAR = 160
#: Characters of all patterns that are broadcast; more are joined.
MOST_BROADCAST = 8 << 20
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _literal(pattern: str) -> Column:
    return F.lit(pattern)


def find_spans(text: Column, kind: int, pattern: str, present: str) -> Column:
    """Leftmost non-overlapping matches as (kind, start, end, value), code points, end exclusive."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, _literal(pattern), F.lit(0)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["value"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(part["value"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span))).alias("spans"))

    return F.when(text.rlike(present), F.aggregate(parts, start, step, lambda s: s["spans"])).otherwise(F.array().cast(SPAN))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string of 13 to 19 digits passes Luhn's test; false for other lengths."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * (1 + (n - i) % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.when(n.between(13, 19), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(False)


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: (F.length(F.regexp_replace(x, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(x, "^0+(?=[0-9])", "").try_cast("int"), F.lit(999)) <= 255))


VALID = {"email": lambda v: F.lit(True), "ip": _octets, "card": lambda v: luhn(digits_of(v)), "phone": lambda v: F.length(digits_of(v)).between(9, 15)}
CANDIDATE_VALID = {
    "email": lambda v: F.lit(True),
    "card": lambda v: F.length(digits_of(v)).between(13, 19),
    "phone": lambda v: F.length(digits_of(v)).between(9, 15),
    "secret": lambda v: (F.length(digits_of(v)) >= 4) & v.rlike("[A-Za-z]"),
}


def _valid(spans: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: test(s["value"]))


def _count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def base_spans(text: Column) -> Column:
    """All valid base spans by kind, then start."""
    return F.concat(*[_valid(find_spans(text, k, BASE[x], PRESENT[x]), VALID[x]) for k, x in enumerate(BASE_KINDS)])


def candidate_spans(text: Column) -> Column:
    return F.concat(*[_valid(find_spans(text, KINDS.index(x), p, CANDIDATE_PRESENT[x]), CANDIDATE_VALID[x]) for x, p in CANDIDATES.items()])


def _with_contexts(text: Column, spans: Column) -> Column:
    """The spans with their patterns: word before, two words before and word after, lower-cased; null at the text's ends.
    Characters glued to the span are passed over. Words are whole, however long."""
    word = lambda x, p, group=1: F.nullif(F.lower(F.regexp_extract(x, p, group)), F.lit(""))
    two = r"(\S++)\s++(\S++)\s++\S*+$"

    def near(s: Column) -> Column:
        # White space before the two words, or after the next one, shows that nothing of them is cut off.
        left, right = F.substring(text, F.greatest(s["start"] - (NEAR - 1), F.lit(1)), F.least(s["start"], F.lit(NEAR))), F.substring(text, s["end"] + 1, F.lit(NEAR))
        left = F.when((s["start"] <= NEAR) | left.rlike(r"\s\S+\s+\S+\s+\S*$"), left).otherwise(F.substring(text, F.lit(1), s["start"]))
        right = F.when(right.rlike(r"^\S*\s+\S+\s"), right).otherwise(F.substring(text, s["end"] + 1, F.length(text)))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), word(left, r"(\S++)\s++\S*+$").alias("before"), F.concat(word(left, two), F.lit(" "), word(left, two, 2)).alias("before2"), word(right, r"^\S*+\s++(\S++)").alias("after"))

    return F.transform(spans, near)


def _spans_table(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base, seeds and cands of every row; doc_id and row_key together are equal for equal rows only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("row_key", F.xxhash64("text"))
    apart = lambda column, others: F.filter(column, lambda c: ~F.exists(others, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("cands", candidate_spans(F.col("text")))
    seeds = F.filter(find_spans(F.col("text"), KINDS.index("secret"), SECRET_SEED, SECRET_SEED_PRESENT), lambda s: F.crc32(s["value"].cast("binary")) % SEED_SHARE == 0)
    rows = rows.withColumn("seeds", apart(seeds, "base"))
    rows = rows.withColumn("cands", apart("cands", F.concat("base", "seeds")))
    return rows.select("doc_id", "row_key", *[_with_contexts(F.col("text"), F.col(c)).alias(c) for c in ("base", "seeds", "cands")])


def _pattern_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """How often the words and word pairs ``wanted`` (word) occur in the corpus.

    They are broadcast if they have no more than MOST_BROADCAST characters; more are joined after all words have been
    counted.
    """
    words = F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), F.lower)
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.size("words")), lambda a, b: F.concat(a, F.lit(" "), b))
    split = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").select(words.alias("words"))
    occurring = split.select(F.explode(F.concat("words", pairs)).alias("word"))
    count = lambda df: df.groupBy("word").agg(F.count("*").alias("total"))
    if (wanted.agg(F.sum(F.length("word") + 16)).head()[0] or 0) <= MOST_BROADCAST:
        return count(occurring.join(F.broadcast(wanted), "word", "left_semi"))
    return count(occurring).join(wanted, "word", "left_semi")


def discover(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Candidates of ``spans`` that high-confidence patterns vouch for: doc_id, row_key, kind, start, end, value.

    Only patterns beside MIN_SUPPORT different known identifiers are counted in the corpus, each once, in the round in
    which it has so many.
    """
    scratch = Scratch(docs.sparkSession)
    one = lambda column, seed: spans.select("doc_id", "row_key", F.explode(column).alias("s"), F.lit(seed).alias("seed")).select("doc_id", "row_key", "s.*", "seed")
    found = one("base", 1.0).union(one("seeds", 1.0)).union(one("cands", 0.0))
    key, pattern = F.lower(F.col("value")), ["kind", "side", "word"]
    sides = F.array(*[F.struct(F.lit(x).alias("side"), F.col(x).alias("word")) for x in ("before", "before2", "after")])
    edges = found.select("kind", key.alias("instance"), "seed", F.explode(sides).alias("p")).select("kind", "instance", "seed", "p.side", "p.word").where("word is not null")
    edges = scratch.write(edges.groupBy(*pattern, "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "all-edges")
    files = scratch.files_for(edges)  # what follows is no larger
    # Only these can ever have the support.
    enough = edges.groupBy(*pattern).agg(F.count("*").alias("instances")).where(F.col("instances") >= MIN_SUPPORT).drop("instances")
    edges = scratch.write(edges.join(enough, pattern), "pattern-edges", files)
    instances, totals = edges.groupBy("kind", "instance").agg(F.max("seed").alias("score")), None
    for _ in range(ROUNDS):
        score = F.when(F.col("score") > 0, F.col("score")).otherwise(UNJUDGED)
        beside = edges.join(instances, ["kind", "instance"]).groupBy(*pattern).agg(F.sum(F.col("n") * score).alias("mass"), F.sum(F.when(F.col("score") >= MIN_SCORE, 1).otherwise(0)).alias("support"))
        beside = scratch.write(beside.where(F.col("support") >= MIN_SUPPORT), "supported", files)
        wanted = beside.select("word").distinct()
        wanted = scratch.write(wanted if totals is None else wanted.join(totals, "word", "left_anti"), "patterns", files)
        if wanted.head(1):
            new = scratch.write(_pattern_counts(docs, wanted), "totals", files)
            totals = new if totals is None else totals.union(new)
        if totals is None:
            break
        weights = beside.join(totals, "word").select(*pattern, F.least(F.col("mass") / F.col("total"), F.lit(1.0)).alias("weight"))
        instances = scratch.write(edges.join(weights, pattern, "left").groupBy("kind", "instance").agg(F.greatest(F.max("seed"), F.coalesce(F.max("weight"), F.lit(0.0))).alias("score")), "instances", files)
    good = instances.where(F.col("score") >= MIN_SCORE)
    out = scratch.write(found.where("seed = 0").withColumn("instance", key).join(good, ["kind", "instance"], "left_semi").select("doc_id", "row_key", "kind", "start", "end", "value").distinct(), "discovered")
    scratch.drop_all_but(out)
    return out


def _same_row(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.row_key") == F.col(f"{right}.row_key"))


def _all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, base and spans (base, seeds and discovered, by kind and start) of every row."""
    table = Scratch(docs.sparkSession).write(_spans_table(docs), "spans")
    extra = discover(docs, table).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("kind", "start", "end", "value")).alias("extra"))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    rows = table.alias("t").join(extra.alias("x"), _same_row("t", "x"), "left").select("t.*", "x.extra")
    return rows.select("doc_id", "row_key", bare("base").alias("base"), F.array_sort(F.concat(bare("base"), bare("seeds"), F.coalesce("extra", F.array().cast(SPAN)))).alias("spans"))


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in every text of ``docs`` (doc_id, text).

    Returns doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans, all spans as
    kind:start:end joined by commas, by kind and start in code points, and n_spans, their number. A null text counts as
    empty; a null doc_id stays null; repeated rows are reported each and count as often as evidence; texts are searched
    whole, and so are the words beside spans; an empty table gives no rows; other columns, whatever their names, are ignored. Finding the places of n spans
    in one text takes time in n * n.
    """
    rows = _all_spans(docs)
    counts = [_count("base", k).alias(f"n_{x}") for k, x in enumerate(BASE_KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind in brackets; overlapping spans as one,
    named after the first. ``n_chars``, if there, follows the new text. All rows stay, repeated ones too, and all other
    columns, whatever their names. A null or empty text stays as it is; an empty table stays empty."""
    found = _all_spans(docs).where(F.size("spans") > 0).select("doc_id", "row_key", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).alias("spans")).dropDuplicates(["doc_id", "row_key"])
    names = F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS])
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("row_key"))
    rows = rows.alias("r").join(found.alias("f"), _same_row("r", "f"), "left").select("r.row", "r.text", "f.spans")

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    rows = rows.withColumn("clean", F.when(F.col("spans").isNotNull(), clean))
    new = {"text": F.col("clean"), "n_chars": F.length("clean")}
    return rows.select(*[(F.when(F.col("spans").isNull(), F.col("row")[c]).otherwise(new[c].cast(docs.schema[c].dataType)) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
