"""Personal data, and terms that would give it away.

Patterns find the protected entities: the base kinds, and secrets, which are long strings of so much information a
character that nobody spells them by heart. Corpus co-occurrence then says how much a term in an entity's documents
discloses: the pointwise mutual information of term and entity, counted by documents over whole texts, as a share of the
entity's own information content. Terms above a threshold are removed, those above a lower one generalised, wherever
they stand. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut, table

#: The patterns, with possessive quantifiers and starts at which alone a match can begin, so that long runs take linear
#: time; they match what the plain patterns match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth trying.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A secret: so many characters without a break, letters and digits among them, of at least so many bits a character.
SECRET, SECRET_BITS = r"(?<![A-Za-z0-9+_=-])[A-Za-z0-9+_=-]{20,}+", 3.0
KINDS = (*PATTERNS, "secret")
#: Characters on either side of an entity that tell its contexts apart, and the shortest term.
CONTEXT, LETTERS = 80, 4
#: A term must stand with the entity in so many documents that aren't copies of each other. A document counts once, however
#: often it names the entity, and those whose first or whose last contexts (in the order of texts) are the same count as one.
SUPPORT = 3
#: Shares of an entity's information that a term may disclose before it is generalised, and before it is removed.
GENERALISE, REMOVE = 0.9, 0.97


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _bits(s: Column) -> Column:
    """The entropy of a string's characters."""
    n = F.length(s)
    each = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))

    def add(total: Column, c: Column) -> Column:
        p = (n - F.length(F.replace(s, c, F.lit("")))) / n
        return total - p * F.log2(p)

    return F.aggregate(each, F.lit(0.0), add)


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "secret":
        return F.when(match.rlike("[0-9]") & match.rlike("[A-Za-z]"), _bits(match) >= SECRET_BITS).otherwise(False)
    if kind == "ip":
        return match.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def located(text: Column, pattern: Column | str, valid, context: int = 0) -> Column:
    """array of (start, end, value, before, after) of the valid matches, in code points: the texts between the matches
    give their places."""
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    pieces = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        before = F.right(x["p"], F.lit(context)) if context else F.lit("")
        after = F.left(x["q"], F.lit(context)) if context else F.lit("")
        found = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value"), before.alias("before"), after.alias("after"))
        return F.struct(end.alias("at"), F.when(valid(x["m"]), F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def scan(found: Column, between: Column) -> Column:
        n = F.size(found)
        zipped = F.arrays_zip(F.slice(between, 1, n).alias("p"), found.alias("m"), F.slice(between, 2, n).alias("q"))
        return F.aggregate(zipped, begin, step, lambda acc: acc["out"])

    # each regex runs over a text once, whatever follows uses its result
    inner = F.transform(F.array(F.struct(matches.alias("m"))), lambda s: F.when(F.size(s["m"]) > 0, scan(s["m"], pieces)).otherwise(F.array().cast(kind)))
    return inner[0]


_SPANS = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def entities(docs: DataFrame) -> DataFrame:
    """(_row, _key, doc_id, email, ip, card, phone, secret, words): the spans of every row with their contexts, and of the
    rows that have any the different longer words. _row numbers the rows, _key tells apart rows of one doc_id with
    different texts."""
    frame = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    text = F.col("text")
    cols = []
    for kind, pattern in (*PATTERNS.items(), ("secret", SECRET)):
        if kind in HINTS:
            seen = text.contains(HINTS[kind])
        else:
            seen = text.rlike("[0-9][\\x20-]?[0-9]" if kind == "card" else "[A-Za-z0-9+_=-]{20}")
        spans = located(text, pattern, lambda m, kind=kind: _valid(kind, m), CONTEXT)
        cols.append(F.when(seen, spans).otherwise(F.array().cast(_SPANS)).alias(kind))
    rows = frame.select(F.monotonically_increasing_id().alias("_row"), F.xxhash64("doc_id", "text").alias("_key"), "doc_id", "text", *cols)
    held = sum((F.size(k) for k in KINDS), F.lit(0)) > 0
    return rows.withColumn("words", F.when(held, _terms_of(text)).otherwise(F.array().cast("array<string>"))).drop("text")


def _terms_of(text: Column) -> Column:
    """The different longer words of a text, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\P{L}+"), lambda w: F.length(w) >= LETTERS))


def _holders(found: DataFrame) -> DataFrame:
    """(_row, entity, context): every mention of an entity, named by its kind and normalised value."""
    every = []
    for kind in KINDS:
        value = F.col("m.value") if kind == "secret" else F.lower("m.value") if kind in ("email", "ip") else F.regexp_replace("m.value", "[^0-9]", "")
        every.append(found.select("_row", F.explode(kind).alias("m")).select("_row", F.concat(F.lit(f"{kind}:"), value).alias("entity"), F.struct("m.before", "m.after").alias("context")))
    rows = every[0]
    for one in every[1:]:
        rows = rows.unionByName(one)
    return rows


def _words(docs: DataFrame) -> DataFrame:
    """(_key, term): the different longer words of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("_key"), F.explode(_terms_of(text)).alias("term"))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(term, share) of the terms that disclose too much of any entity, over counts of rows.

    Entities with fewer than SUPPORT unlike documents can't have such a term, nor can terms that stand in more rows than any
    entity allows: log2(N n_both / (n_entity n_term)) >= GENERALISE log2(N / n_entity) asks for n_term <= n_entity (N /
    n_entity)^(1 - GENERALISE). Both fall out before entities meet words.
    """
    total = float(max(found.count(), 1))
    ends = [F.xxhash64(f("context")).alias(c) for f, c in ((F.min, "first"), (F.max, "last"))]
    holders = cut(_holders(found).groupBy("_row", "entity").agg(*ends))  # a row for each document that names an entity
    sizes = holders.groupBy("entity").agg(F.count("*").alias("n_entity"), F.countDistinct("first").alias("unlike"), F.countDistinct("last").alias("unlike_last"))
    most = F.col("n_entity") * F.pow(total / F.col("n_entity"), F.lit(1 - GENERALISE))
    sizes = cut(sizes.filter(F.least("unlike", "unlike_last") >= SUPPORT).select("entity", "n_entity", most.alias("most")))
    limit = sizes.agg(F.max("most")).first()[0] or 0.0
    held = holders.join(sizes, "entity")
    # counted where they stand: only sums of each task are shuffled
    counts = _words(docs).groupBy("term").agg(F.count("*").alias("n_term")).filter(F.col("n_term").between(SUPPORT, limit))
    rare = found.join(held.select("_row").distinct(), "_row", "left_semi").select("_row", F.explode("words").alias("term")).join(counts, "term")
    pairs = rare.join(held, "_row").filter("n_term <= most")
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.countDistinct("first").alias("unlike"), F.countDistinct("last").alias("unlike_last"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    information = F.log2(F.lit(total) / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    share = F.when(information > 0, mutual / F.when(information > 0, information))
    return cut(pairs.filter(F.least("unlike", "unlike_last") >= SUPPORT).withColumn("share", share).groupBy("term").agg(F.max("share").alias("share")).filter(F.col("share") >= GENERALISE))


def _between(low: float, high: float):
    return lambda t: (t["share"] >= low) & (t["share"] < high)


def term_spans(docs: DataFrame, shares: DataFrame) -> DataFrame:
    """(_key, remove, generalise): arrays of the places of disclosing terms, for the rows that have any."""
    per_row = _words(docs).join(bounded_broadcast(shares), "term").groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("term", "share"))).alias("terms"))
    per_row = cut(per_row)
    texts = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_key"), F.coalesce("text", F.lit("")).alias("text")).join(bounded_broadcast(per_row, size=40 * F.size("terms") + 16), "_key")
    cols = []
    for name, low, high in (("remove", REMOVE, 9.0), ("generalise", GENERALISE, REMOVE)):
        own = F.transform(F.filter("terms", _between(low, high)), lambda t: t["term"])
        regex = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(own, "|"), F.lit(r")(?!\p{L})"))
        spans = F.transform(located(F.col("text"), regex, lambda m: F.lit(True)), lambda s: F.struct(s["start"], s["end"]))
        cols.append(F.when(F.size(own) > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias(name))
    return texts.select("_key", *cols).dropDuplicates(["_key"])


def spans_of(docs: DataFrame) -> DataFrame:
    """(_key, doc_id, email, ip, card, phone, secret, remove, generalise) for every row of ``docs`` (doc_id, text; other
    columns are ignored): arrays of (start, end), code points, end exclusive, ascending.

    Null and empty texts have no spans, a null doc_id is an id like others. Very long texts are searched whole, in linear
    time. Repeated rows have the same spans and count as rows each, though as one document that supports a term. Of a term's shares for several
    entities the largest counts; at exactly a threshold, the threshold is reached. Without any entity no term is
    disclosing. Empty tables give no rows.
    """
    found = cut(entities(docs))
    extra = bounded_broadcast(cut(term_spans(docs, disclosing_terms(docs, found))), size=8 * (F.size("remove") + F.size("generalise")) + 16)
    plain = [F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k in KINDS]
    none = F.array().cast("array<struct<start:int,end:int>>")
    return found.select("_key", "doc_id", *plain).join(extra, "_key", "left").select("_key", "doc_id", *KINDS, *(F.coalesce(k, none).alias(k) for k in ("remove", "generalise")))


def _named(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"])


def _joined(kinds) -> Column:
    return F.array_join(F.concat(*(F.transform(k, _named(k)) for k in kinds)), ",")


def _tagged(kind: str, text: Column):
    """A span with what stands in its place: a kind's name, nothing for a term that is removed, and for one that is
    generalised the beginning that it shares with other words."""

    def tag(s: Column) -> Column:
        half = F.substring(text, s["start"] + 1, F.ceil((s["end"] - s["start"]) / 2).cast("int"))
        put = {"remove": F.lit(""), "generalise": F.concat(half, F.lit("*"))}.get(kind, F.lit(f"<{kind}>"))
        return F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), put.alias("put"))

    return tag


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every entity replaced by its kind in angle brackets, terms that disclose too much removed, and
    those that disclose less generalised to the first half of their letters and an asterisk. Of overlapping spans the
    first counts, and the longer of those that begin together. Null texts stay null; rows without spans stay as they
    are."""
    spans = spans_of(docs).select("_key", *KINDS, "remove", "generalise").dropDuplicates(["_key"])
    spans = cut(spans.filter(sum((F.size(k) for k in (*KINDS, "remove", "generalise")), F.lit(0)) > 0))
    spans = bounded_broadcast(spans, size=16 * sum((F.size(k) for k in (*KINDS, "remove", "generalise")), F.lit(1)))

    def step(acc: Column, t: Column) -> Column:
        more = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, t["start"] - acc["at"]), t["put"])
        open_ = t["start"] >= acc["at"]
        return F.struct(F.when(open_, -t["minus"]).otherwise(acc["at"]).alias("at"), F.when(open_, more).otherwise(acc["out"]).alias("out"))

    keyed = docs.select("doc_id", F.col("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("_key")).join(spans, "_key", "left")
    tags = F.array_sort(F.concat(*(F.transform(k, _tagged(k, F.col("text"))) for k in (*KINDS, "remove", "generalise"))))
    clean = F.aggregate(tags, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return keyed.select("doc_id", F.coalesce(clean, "text").alias("text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = spans_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spans.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(_joined(PATTERNS), 256).alias("base_sha256"),
        _joined((*KINDS, "remove", "generalise")).alias("spans"),
        F.size("secret").cast("long").alias("n_secret"),
        (F.size("remove") + F.size("generalise")).cast("long").alias("n_terms"),
    )
