"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame operations only.

Base spans (email, ip, card, phone) are found where a text is read: the pieces between matches
and the matches themselves give all places by running sums. Long strings that mix letters and
digits, as keys and passwords do, are protected entities too (secret).

What stands around an entity can give it away as well. For every term near a protected entity
the corpus tells how strongly the term reveals it, as a value, as one of a cluster (mail
domain, network, prefix) and by its kind: in how many texts they meet, in how many the term
occurs at all, and so the probability of the entity given the term, and what share of the
entity's own information content that is. A term that reveals enough of any of the three is
personal wherever it occurs. From GENERALISE on it is generalised, from REMOVE on removed.

Evidence must come from different texts. All counts are over distinct texts, and near copies
have one sketch (the least hash of a shingle): the texts in which a term meets an entity count
as many as their sketches make effectively, the inverse of the chance that two have the same.

Only rows of entities and nearby terms are shuffled. The terms still in question go back to
the texts as a filter of bounded size, texts that hold a disclosing term by another one; no
broadcast grows with the data.

Defined results: a null text is empty; equal texts have equal spans, whatever their ids; null
and repeated ids pass through row by row; an empty table gives no rows. Places are code
points, ends exclusive. Spans of different kinds may overlap; sanitised text replaces what
overlaps as one, by the kind that begins first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import cut, may_hold, names, quoted, table

#: What the base patterns match. Possessive repeats and the look behind only keep
#: Java's matcher from recursion and from trying a run of letters again from each of its places.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Strings of 16 letters and digits at least, three of both at least.
PROTECTED = PATTERNS | {"secret": r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]{16})(?=(?:[A-Za-z]*+[0-9]){3})(?=(?:[0-9]*+[A-Za-z]){3})[A-Za-z0-9]++"}
KINDS = [*PROTECTED, "term"]
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": "[0-9]"}
#: Characters on each side of an entity whose words count as near it; words have two letters or digits at least, a letter among them.
NEAR = 80
TERM = r"(?<![\p{L}\p{N}])(?=\p{N}*+\p{L})[\p{L}\p{N}]{2,}+"
#: Different texts (effectively), the share of an entity's information, and probabilities that make a term disclosing.
EVIDENCE = 3.0
SHARE = 0.75
GENERALISE = 0.5
REMOVE = 0.9
#: Words of the shingles that a text's sketch is the least of.
SKETCH_WORDS = 3
#: Ways that rows of equal texts are dealt to.
SALT = 8


#: Matches whose lengths are added up together.
BLOCK = 128


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def in_blocks(sizes: Column) -> Column:
    """An array of longs cut into arrays of BLOCK."""
    last = F.ceil(F.size(sizes) / BLOCK).cast("int") - 1
    return F.when(F.size(sizes) > 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array().cast("array<array<bigint>>"))


def before(sums: Column) -> Column:
    """What stands before each block."""
    return F.transform(sums, lambda _, k: total(F.slice(sums, F.lit(1), k)))


def running(blocks: Column, starts: Column) -> Column:
    """Running sums of an array in blocks, from where each block starts; long arrays cost little more than in proportion."""
    return F.flatten(F.transform(blocks, lambda x, k: F.transform(x, lambda _, i: F.get(starts, k) + total(F.slice(x, F.lit(1), i + 1)))))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    from_right = F.reverse(number)

    def term(i: Column) -> Column:
        d = F.substring(from_right, i, F.lit(1)).try_cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), term), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits(value)).between(12, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _validity(kind: str):
    return lambda x: valid(kind, x["value"])


def matched(text: Column, pattern: str, hint: str | None = None) -> Column:
    """All matches of a pattern; an empty array for texts without."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(hint)), found).otherwise(F.array().cast("array<string>")) if hint else found


def located(df: DataFrame, text: Column, patterns: dict[str, str | Column], found: str, out: str) -> DataFrame:
    """``df`` with the places of each kind's matches (in columns ``found`` + kind) in columns ``out`` + kind, null without any.

    A place is (start, end, value, left, right): left and right are the texts up to the neighbouring
    matches, with a space for an end of the text. Each step has columns of its own: what a lambda refers
    to is made again for each element, unless it is a column.
    """
    kept = [quoted(c) for c in df.columns]
    of = lambda step: lambda k: F.col(f"{found}{step}_{k}")
    gap, size, block, sums, start, end = map(of, "gzbspe")
    match = lambda k: F.col(found + k)

    def more(make: Callable[[str], Column], step: str, made_of: Callable[[str], Column]) -> None:
        # Two references to a column keep it one: a column that is used once moves into the lambda that uses it.
        nonlocal df
        df = df.select("*", *(F.when(F.size(made_of(k)) > 0, make(k)).alias(f"{found}{step}_{k}") for k in patterns))

    more(lambda k: F.split(text, patterns[k], -1), "g", match)
    more(lambda k: F.zip_with(F.slice(gap(k), F.lit(1), F.size(match(k))), match(k), lambda g, m: (F.length(g) + F.length(m)).cast("long")), "z", gap)
    more(lambda k: in_blocks(size(k)), "b", size)
    more(lambda k: F.transform(block(k), total), "s", block)
    more(lambda k: before(sums(k)), "p", sums)
    more(lambda k: running(block(k), start(k)), "e", start)

    def spans(k: str) -> Column:
        n = F.size(match(k))
        left = F.concat(F.array(F.concat(F.lit(" "), F.element_at(gap(k), 1))), F.slice(gap(k), F.lit(2), n - 1))
        right = F.concat(F.slice(gap(k), F.lit(2), n - 1), F.array(F.concat(F.element_at(gap(k), -1), F.lit(" "))))
        zipped = F.arrays_zip(end(k).alias("end"), match(k).alias("value"), left.alias("left"), right.alias("right"))
        return F.transform(zipped, lambda x: F.struct((x["end"] - F.length(x["value"])).alias("start"), x["end"].alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))

    return df.select(*kept, *(F.when(F.size(match(k)) > 0, spans(k)).alias(out + k) for k in patterns))


def with_base(df: DataFrame, text: Column, prefix: str, contexts: bool) -> DataFrame:
    """``df`` with one array of spans for each protected kind, in columns ``prefix`` + kind: (start, end) or with value and both sides."""
    kept = [quoted(c) for c in df.columns]
    df = df.select("*", *(matched(text, p, HINTS[k]).alias(f"{prefix}m_{k}") for k, p in PROTECTED.items()))
    df = located(df, text, PROTECTED, f"{prefix}m_", f"{prefix}l_")
    made = []
    for k in PROTECTED:
        found = F.filter(f"{prefix}l_{k}", _validity(k))
        slim = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
        made.append((found if contexts else slim).alias(f"{prefix}{k}"))
    return df.select(*kept, *made)


def terms_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def around(m: Column) -> Column:
    """The text near a match on both sides, without words that a match or the border cuts."""
    without = lambda text, *cut_off: without(F.regexp_replace(text, cut_off[0], ""), *cut_off[1:]) if cut_off else text
    edges = r"^[\p{L}\p{N}]+", r"[\p{L}\p{N}]+$"
    return F.concat_ws("\n", without(F.right(m["left"], F.lit(NEAR)), *edges), without(F.left(m["right"], F.lit(NEAR)), *edges))


def entities_of(kind: str, value: Column) -> Column:
    """What a match stands for: itself, its cluster and its kind."""
    of = F.lower(value) if kind in ("email", "ip", "secret") else digits(value)
    cluster = {"email": F.regexp_extract(of, "@(.*)$", 1), "ip": F.regexp_extract(of, r"^(.*)\.", 1), "card": F.left(of, F.lit(6)), "phone": F.left(of, F.lit(4)), "secret": F.length(of).cast("string")}[kind]
    return F.array(F.concat(F.lit(kind + "="), of), F.concat(F.lit(kind + "~"), cluster), F.lit(kind))


def sketch(text: Column) -> Column:
    """The least hash of a text's shingles: one for near copies, as a rule, and different for other texts."""

    def least(words: Column) -> Column:
        shingle = lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SKETCH_WORDS)))
        return F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - SKETCH_WORDS, F.lit(0))), shingle))

    # The words are made once: a lambda's variable is not evaluated again.
    return F.element_at(F.transform(F.array(F.split(F.lower(text), r"\s+")), least), 1)


def made_once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df.select(columns)`` as a floor for filters: one that moved below it would make costly expressions again."""
    (row,) = names(df.select(*columns), "row")
    return df.select(*columns, F.monotonically_increasing_id().alias(row)).filter(quoted(row) >= 0).drop(row)


def held_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term) of all texts (key, text) and the ``terms`` (materialised) that they hold."""
    words = made_once(texts, F.col("key"), F.array_distinct(terms_in(F.col("text"))).alias("words")).select("key", F.explode("words").alias("term"))
    met = may_hold(words, F.xxhash64("term"), cut(terms.select(F.xxhash64("term").alias("h"))), "hit").filter("hit").select("key", "term").distinct()
    return met.join(terms, "term")


def disclosing_terms(texts: DataFrame, evidence: float = EVIDENCE, share: float = SHARE, generalise: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(terms, hits) from ``texts`` (key, text): term with its strongest probability, and (key, term) of all texts that hold one."""
    some = texts.filter(F.regexp_like("text", F.lit("@|[0-9]")))
    base = with_base(some, F.col("text"), "b_", contexts=True)
    named = lambda kind: lambda m: F.struct(entities_of(kind, m["value"]).alias("entities"), around(m).alias("around"))
    none = F.array().cast("array<struct<entities:array<string>,around:string>>")
    every = F.concat(*(F.coalesce(F.transform(f"b_{k}", named(k)), none) for k in PROTECTED))
    found = made_once(base, F.col("key"), every.alias("m"), F.col("text")).filter(F.size("m") > 0).select("key", "m", sketch(F.col("text")).alias("sketch"))
    mentions = cut(found.select("key", "sketch", F.explode("m").alias("m")).select("key", "sketch", "m.entities", "m.around").distinct())
    near_terms = mentions.select("key", "sketch", "entities", F.explode(F.array_distinct(terms_in(F.col("around")))).alias("term")).select("key", "sketch", "term", F.explode("entities").alias("entity"))
    # A term and an entity in one text count once, however often they meet there.
    meetings = near_terms.groupBy("term", "entity", "key").agg(F.first("sketch").alias("sketch"))
    alike = meetings.groupBy("term", "entity", "sketch").agg(F.count("*").alias("n"))
    pairs = alike.groupBy("term", "entity").agg(F.sum("n").alias("together"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    by_term = near_terms.groupBy("term", "key").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias("near"))
    # A term occurs in as many texts as it does near entities, at least: many pairs are out by that. More are out by
    # the texts that hold an entity; the others are counted in all.
    open_pairs = cut(pairs.filter(F.col("together") * F.col("together") >= evidence * F.col("squares")).join(by_term, "term").filter(F.col("together") >= generalise * F.col("near")))
    holders = cut(mentions.select(F.xxhash64("key").alias("h")).distinct())
    inside = held_terms(may_hold(texts, F.xxhash64("key"), holders, "held").filter("held").select("key", "text"), cut(open_pairs.select("term").distinct()))
    inside = inside.groupBy("term").agg(F.count("*").alias("inside"))
    open_pairs = cut(open_pairs.join(inside, "term").filter(F.col("together") >= generalise * F.col("inside")))
    seen = cut(held_terms(texts, cut(open_pairs.select("term").distinct())))
    often = seen.groupBy("term").agg(F.count("*").alias("texts"))
    entities = mentions.select(F.explode("entities").alias("entity"), "key").distinct().groupBy("entity").agg(F.count("*").alias("entity_texts"))
    total = texts.agg(F.count_distinct("key").alias("total"))
    probability = F.col("together") / F.col("texts")
    content = F.log2(F.col("total") / F.col("entity_texts"))
    information = F.log2(probability) + content
    terms = open_pairs.join(often, "term").join(entities, "entity").crossJoin(F.broadcast(total)).filter((probability >= generalise) & (content > 0) & (information >= share * content)).groupBy("term").agg(F.max(probability).alias("probability"))
    terms = cut(terms)
    return terms, seen.join(terms, "term")


SPANS = "array<struct<start:bigint,end:bigint,remove:boolean>>"


def term_spans(texts: DataFrame, **thresholds: float) -> DataFrame:
    """(key, spans) of texts with disclosing terms; spans: (start, end, remove)."""
    _, hits = disclosing_terms(texts, **thresholds)
    held = cut(hits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "probability"))).alias("terms")))
    few = may_hold(texts, F.xxhash64("key"), cut(held.select(F.xxhash64("key").alias("h"))), "hit").filter("hit").select("key", "text").dropDuplicates(["key"])
    found = located(few.join(held, "key").withColumn("m_term", F.regexp_extract_all("text", F.lit(TERM), F.lit(0))), F.col("text"), {"term": TERM}, "m_", "l_")
    spans = F.filter("l_term", lambda x: F.map_contains_key("terms", F.lower(x["value"])))
    return found.select("key", F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (F.col("terms")[F.lower(x["value"])] >= REMOVE).alias("remove"))).alias("term_spans"))


def with_terms(df: DataFrame, key: str, more: DataFrame, out_col: str) -> DataFrame:
    """``df`` with the term spans of its texts (``more``: key, term_spans; materialised), null without any.

    Rows whose text has none stay where they are; the others meet theirs in a join, in which equal texts are dealt to SALT ways.
    """
    hit, salt, other, ways = names(df, "hit", "salt", "other", "ways")
    columns = [quoted(c) for c in df.columns]
    marked = may_hold(df, F.xxhash64(quoted(key)), cut(more.select(F.xxhash64("key").alias("h"))), hit)
    plain = marked.filter(~quoted(hit)).select(*columns, F.lit(None).cast(SPANS).alias(out_col))
    dealt = marked.filter(quoted(hit)).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    spread = more.select(F.col("key").alias(other), F.col("term_spans").alias(out_col), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias(ways))
    met = dealt.join(spread, (quoted(key) == quoted(other)) & (quoted(salt) == quoted(ways)), "left")
    return plain.union(met.select(*columns, quoted(out_col)))


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with."""
    prefix = "b_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def key_of(text: Column) -> Column:
    return F.md5(text)


def find(df: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``df`` (without the text, unless asked for) with column ``spans``: (start, kind_no, kind, end, remove) in order."""
    kept = [c for c in df.columns if c not in (text_col, "spans")]
    key, body, more_col = names(df, "key", "body", "term_spans")
    prefix = free_prefix(df)
    text = F.coalesce(quoted(text_col), F.lit(""))
    more = cut(term_spans(df.select(key_of(text).alias("key"), text.alias("text"))))
    read = with_terms(df.select(*(quoted(c) for c in kept), text.alias(body), key_of(text).alias(key)), key, more, more_col)
    base = with_base(read, F.col(body), prefix, contexts=False)

    def tagged(column: Column, kind: str, remove: Column | None = None) -> Column:
        return F.transform(F.coalesce(column, F.array().cast("array<struct<start:bigint,end:bigint>>") if remove is None else F.array().cast(SPANS)), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), x["end"].alias("end"), (x["remove"] if remove is not None else F.lit(False)).alias("remove")))

    found = F.array_sort(F.concat(*(tagged(F.col(f"{prefix}{k}"), k) for k in PROTECTED)))
    every = F.when(F.col(more_col).isNull(), found).otherwise(F.array_sort(F.concat(found, tagged(F.col(more_col), "term", F.lit(1)))))
    return base.select(*(quoted(c) for c in kept), *([F.col(body).alias(text_col)] if keep_text else []), every.alias("spans"))


def sanitise(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with personal data replaced by its kind, and strongly disclosing terms removed.

    Texts without a disclosing term, nearly all, are rewritten where they are read; the others
    meet their terms in a join, reached by a bitmap of bounded size.
    """
    key, spans, more_col = names(df, "key", "spans", "term_spans")
    text = F.coalesce(quoted(text_col), F.lit(""))
    more = cut(term_spans(df.select(key_of(text).alias("key"), text.alias("text"))))
    both = with_terms(df.withColumn(key, key_of(text)), key, more, more_col)
    prefix = free_prefix(both)
    found = with_base(both, text, prefix, contexts=False)
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    struct = lambda kind: lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), x["end"].alias("end"), F.lit(f"<{kind.upper()}>").alias("by"))
    terms = F.transform(F.coalesce(more_col, F.array().cast(SPANS)), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("term")).alias("kind_no"), x["end"].alias("end"), F.when(x["remove"], "").otherwise("<TERM>").alias("by")))
    every = F.array_sort(F.concat(*(F.transform(F.coalesce(F.col(f"{prefix}{k}"), empty), struct(k)) for k in PROTECTED), terms))
    found = found.withColumn(spans, every)
    # What overlaps is one: a span is left out if an earlier one reaches over its start.
    sweep = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["end"]).alias("at"),
            F.when(x["start"] < a["at"], a["parts"]).otherwise(F.concat(a["parts"], F.array(F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), x["by"]))).alias("parts"),
        ),
        lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    new = F.when(F.size(spans) > 0, sweep).otherwise(quoted(text_col))
    return found.select(*(new.alias(c) if c == text_col else quoted(c) for c in df.columns))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(*PATTERNS))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k in PATTERNS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {"op4_pii": op4_pii}
SQL: dict[str, str] = {}
