"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Patterns find the protected entities: e-mail and IP addresses, card and phone numbers. Most stand in one text only, so each
also belongs to classes that recur: its domain, the parts of its local name, the prefixes of its number. The corpus tells how
strongly a term in a sentence of an entity reveals it or a class of it: the pointwise mutual information of both, against the
information content of the entity or class. A term that comes close to it stands for it wherever both appear in a text; it is
generalised, or removed where it reveals all of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.frames import cut

# The patterns of the four kinds. They match what their plain forms match; possessive loops and the look behind
# the first character keep the time linear on long runs, and the card's repetition leaves out runs that are too short.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
#: A cheap test that a text must pass to be searched for a kind.
HINTS = {"email": "@", "phone": "+"}
#: Characters on either side of an entity that are its surroundings.
REACH = 80
# A term is a run of letters, marks and digits, also with hyphens or apostrophes inside.
LETTER, JOINT = r"[\p{L}\p{M}\p{N}]", "['\u2019-]"
TERM = f"{LETTER}++(?:{JOINT}{LETTER}++)*+"
#: What must not stand before and behind a string for it to be a term of the text.
HEAD, TAIL = f"(?<!{LETTER})(?<!{LETTER}{JOINT})", f"(?!{LETTER})(?!{JOINT}{LETTER})"


@dataclass(frozen=True)
class Thresholds:
    """support: different surroundings that must hold entity (or class) and term; generalise, remove: shares of its information
    that a term must reveal."""

    support: int = 3
    generalise: float = 0.3
    remove: float = 0.999


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn() -> Column:
    """Whether the digits in the column rev, last digit first, pass the check sum."""
    doubled = F.expr("aggregate(sequence(1, length(rev)), 0, (s, i) -> s + if(i % 2 = 1, int(substr(rev, i, 1)), int(substr('0246813579', int(substr(rev, i, 1)) + 1, 1))))")
    return doubled % 10 == 0


def is_valid(kind: str) -> Column:
    """Whether the column match is a valid entity of the kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.expr("forall(split(match, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast(ltrim('0', p) as int), 0) <= 255)")
    size = F.length(digits(F.col("match")))
    if kind == "phone":
        return size.between(10, 15)
    return size.between(14, 19) & F.when(size.between(14, 19), luhn()).otherwise(False)


def entry(kind: str):
    """What found keeps of a match, from the match and the texts before and after it: its surroundings and its sentence, which goes
    on to the next full stop, exclamation mark, question mark or line break on either side, however far they are."""
    stops = lambda x: F.translate(x, "!?\n", "...")
    sentence = lambda x: F.concat_ws("\n", F.substring_index(stops(x["1"]), ".", -1), F.substring_index(stops(x["2"]), ".", 1))
    return lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.length(x["1"]).alias("gap"), x[f"m_{kind}"].alias("match"), F.right(x["1"], F.lit(REACH)).alias("before"), F.left(x["2"], F.lit(REACH)).alias("after"), sentence(x).alias("sentence"))


def is_kind(kind: str):
    return lambda s: s["kind"] == kind


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text, found) of every row: found has for each match of each kind its place among the kind's matches, the characters
    between it and the one before, its surroundings and its sentence; text is null where there is no match. row is a number of the row's
    own, fixed as this is written."""
    text = docs[f"`{text_col}`"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[f"`{id_col}`"].alias("id"), text.alias("text"))
    hint = lambda k: F.contains("text", F.lit(HINTS[k])) if k in HINTS else F.col("text").rlike("[0-9]")
    matches = rows.select("*", *[F.when(hint(k), F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"m_{k}") for k, p in PATTERNS.items()])
    pieces = matches.select("*", *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).alias(f"p_{k}") for k, p in PATTERNS.items()])
    none = F.expr("array()").cast("array<struct<kind:string,nth:int,gap:int,match:string,before:string,after:string,sentence:string>>")
    each = []
    for k in PATTERNS:
        n = F.size(f"m_{k}")
        zipped = F.arrays_zip(F.col(f"m_{k}"), F.slice(f"p_{k}", F.lit(1), n), F.slice(f"p_{k}", F.lit(2), n))  # with what is before and after
        each.append(F.coalesce(F.transform(F.when(n > 0, zipped), entry(k)), none))
    return pieces.select("row", "id", "text", F.concat(*each).alias("found")).withColumn("text", F.when(F.size("found") > 0, F.col("text")))


def base_spans(seen: DataFrame) -> DataFrame:
    """(row, kind, start, end, match, value, before, after, sentence): the valid matches, in characters; value is the entity, told apart from
    others regardless of case and punctuation."""
    rows = seen.select("row", F.inline("found"))
    order = Window.partitionBy("row", "kind").orderBy("nth")
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(order)).withColumn("start", F.col("end") - F.length("match"))
    placed = placed.withColumn("rev", F.reverse(digits(F.col("match"))))
    valid = F.lit(False)
    for k in PATTERNS:
        valid = F.when(F.col("kind") == k, is_valid(k)).otherwise(valid)
    value = F.concat(F.col("kind"), F.lit(":"), F.when(F.col("kind") == "email", F.lower("match")).when(F.col("kind") == "ip", F.col("match")).otherwise(digits(F.col("match"))))
    return placed.filter(valid).select("row", "kind", "start", "end", "match", value.alias("value"), "before", "after", "sentence")


def classes() -> Column:
    """The value and the classes it belongs to: domain and parts of the local name; network; number without its last digits;
    issuer of a card."""
    value = F.col("value")
    rest = F.element_at(F.split(value, ":", 2), 2)
    local, domain = F.substring_index(rest, "@", 1), F.substring_index(rest, "@", -1)
    parts = F.transform(F.filter(F.split(local, "[._%+-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("local:"), x))
    of = F.when(F.col("kind") == "email", F.concat(F.array(value, F.concat(F.lit("domain:"), domain)), parts))
    of = of.when(F.col("kind") == "ip", F.array(value, F.concat(F.lit("net3:"), F.substring_index(rest, ".", 3)), F.concat(F.lit("net2:"), F.substring_index(rest, ".", 2))))
    of = of.when(F.col("kind") == "phone", F.array(value, F.concat(F.lit("line:"), F.expr("left(split(value, ':', 2)[1], length(value) - length(kind) - 5)")), F.concat(F.lit("area:"), F.expr("left(split(value, ':', 2)[1], length(value) - length(kind) - 8)"))))
    return of.otherwise(F.array(value, F.concat(F.lit("issuer:"), F.left(rest, F.lit(6)))))


def classed(spans: DataFrame, limits: Thresholds) -> DataFrame:
    """(row, class, place, n_class, sentence) of every entity's classes that have the support at all, n_class the texts with
    the class. class is a hash; place is a hash of an entity and its surroundings, the same for copies of a passage."""
    each = spans.select("row", F.xxhash64("value", "before", "after").alias("place"), "sentence", F.explode(F.array_distinct(F.transform(classes(), lambda c: F.xxhash64(c)))).alias("class"))
    recurring = each.groupBy("class").agg(F.count_distinct("place").alias("places"), F.count_distinct("row").alias("n_class")).filter(F.col("places") >= limits.support)
    return each.join(recurring.drop("places"), "class")


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def term_key(term: Column) -> Column:
    return F.xxhash64(F.lower(term))


def holding(seen: DataFrame, spans: DataFrame, named: DataFrame) -> DataFrame:
    """(row, text, taken, held, terms) of every row with an entity of a class in named: taken are the places of its entities,
    held its classes with one place each, and terms the different terms outside of its entities."""
    held = named.groupBy("row", "class").agg(F.min("place").alias("place")).groupBy("row").agg(F.collect_list(F.struct("class", "place")).alias("held"))
    taken = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("taken"), F.collect_set("match").alias("matches"))
    rows = seen.filter("text is not null").select("row", "text").join(held, "row").join(taken, "row")
    longest = F.array_sort("matches", lambda x, y: F.length(y) - F.length(x))
    blank = F.concat(F.lit("\\Q"), F.array_join(longest, "\\E|\\Q"), F.lit("\\E"))
    return rows.select("row", "text", "taken", "held", terms_of(F.regexp_replace("text", blank, F.lit(" "))).alias("terms"))


def disclosing(docs: DataFrame, text_col: str, named: DataFrame, limits: Thresholds) -> DataFrame:
    """(class, term, reveals) of the pairs over the threshold: reveals is the share of the class's information, PMI / IC.

    Texts are the events: N of them, n(c) with the class, n(t) with the term, n(c, t) where both share a sentence. A pair needs the
    support of entities with different surroundings, so that copies of one passage prove nothing."""
    keys = F.transform(terms_of(F.col("sentence")), term_key)
    told = named.select("row", "class", "place", F.explode(keys).alias("term"))
    pairs = told.groupBy("class", "term").agg(F.count_distinct("place").alias("places"), F.count_distinct("row").alias("both")).filter(F.col("places") >= limits.support)
    sizes = named.select("class", "n_class").distinct()
    pairs = cut(pairs)
    # Counted before anything is joined: a task has each term once, so what is shuffled grows with the vocabulary, not the texts.
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(docs[f"`{text_col}`"], F.lit(TERM), F.lit(0)), term_key))).alias("term"))
    terms = words.groupBy("term").agg(F.count("*").alias("n_term"))
    total = docs.agg(F.count("*").alias("n"))  # one row
    counted = pairs.join(sizes, "class").join(terms, "term").crossJoin(F.broadcast(total))
    bits = F.log2(F.col("n") / F.col("n_class"))
    pmi = F.log2(F.col("n") * F.col("both") / (F.col("n_class") * F.greatest("n_term", "both")))
    return counted.withColumn("reveals", F.when(bits > 0, pmi / bits).otherwise(0.0)).filter(F.col("reveals") >= limits.generalise).select("class", "term", "reveals")


def term_spans(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(row, start, end, reveals) of every place of a term in the text of a row that holds a class it reveals, outside of the
    row's entities."""
    offered = rows.select("row", "held", F.explode("terms").alias("name")).select("row", "name", term_key(F.col("name")).alias("term"), F.explode("held.class").alias("class"))
    hits = offered.join(told, ["class", "term"]).groupBy("row", "name").agg(F.max("reveals").alias("reveals"))
    by_row = hits.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("name", "reveals"))).alias("names"))
    any_of = F.concat(F.lit(HEAD + "(?:"), F.array_join(F.map_keys("names"), "|"), F.lit(")" + TAIL))
    cut_up = rows.join(by_row, "row").withColumn("p", F.split("text", any_of, -1)).withColumn("m", F.regexp_extract_all("text", any_of, F.lit(0)))
    each = cut_up.select("row", "taken", "names", F.posexplode(F.arrays_zip("m", F.slice("p", F.lit(1), F.size("m")).alias("p"))).alias("nth", "x")).select("row", "taken", "nth", F.length("x.p").alias("gap"), F.length("x.m").alias("size"), F.element_at("names", F.col("x.m")).alias("reveals"))
    order = Window.partitionBy("row").orderBy("nth")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)).withColumn("start", F.col("end") - F.col("size"))
    return placed.filter("not exists(taken, s -> s.start < end and start < s.end)").select("row", "start", "end", "reveals")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Thresholds | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows (row, id), and their spans (row, kind, start, end, action): what find_spans and sanitise are made of."""
    limits = limits or Thresholds()
    seen = cut(found(docs, id_col, text_col))
    spans = cut(base_spans(seen))
    named = cut(classed(spans, limits))
    rows = cut(holding(seen, spans, named))
    hits = term_spans(rows, cut(disclosing(docs, text_col, named, limits)))
    terms = hits.select("row", F.lit("term").alias("kind"), "start", "end", F.when(F.col("reveals") >= limits.remove, "remove").otherwise("generalise").alias("action"))
    return seen.select("row", "id"), spans.select("row", "kind", "start", "end", F.lit("generalise").alias("action")).unionByName(terms)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Thresholds | None = None) -> DataFrame:
    """(doc_id, spans) of every row: spans is an array of (start, kind_no, end, kind, action) in characters, by start and kind.

    Base kinds are matched leftmost without overlap, each on its own, and matches that fail the kind's test are dropped;
    spans of kind term are the words, wherever they stand in the text, that disclose one of its entities or a class of it. A null or empty text has no spans. Rows are told apart
    by a number of their own, so repeated rows and null ids are kept as they are; repeated texts count as texts, but not as
    support. An empty table gives no rows; other columns are not read. Memory follows the longest text."""
    rows, spans = find(docs, id_col, text_col, limits)
    number = F.lit(len(KINDS))
    for i, k in enumerate(KINDS):
        number = F.when(F.col("kind") == k, F.lit(i)).otherwise(number)
    by_row = spans.withColumn("kind_no", number).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind_no", "end", "kind", "action"))).alias("spans"))
    kind = by_row.schema["spans"].dataType.simpleString()
    return rows.join(by_row, "row", "left").select(F.col("id").alias("doc_id"), "row", F.coalesce("spans", F.expr("array()").cast(kind)).alias("spans"))


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found_rows: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans and all spans as a string."""
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(F.filter("spans", is_kind(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found_rows.select("doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Thresholds | None = None) -> DataFrame:
    """docs with every span of find_spans replaced in text_col: entities by their kind in brackets, terms by [TERM] or, where
    they reveal all of an entity, by nothing. Overlapping spans are replaced as one, under the kind of the first.

    Rows that share id and text get the same spans; a null text stays null; all columns are kept, whatever their names. An empty
    table gives no rows."""
    text = docs[f"`{text_col}`"]
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), F.struct(docs[f"`{id_col}`"].alias("id"), F.xxhash64(text).alias("tag")).alias("key"), text.alias("text"))
    rows, spans = find(whole.select("key", "text"), "key", "text", limits)
    order = Window.partitionBy("row").orderBy("start", "end", "kind")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("head", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("island", F.sum("head").over(order))
    joined = islands.groupBy("row", "island").agg(F.min("start").alias("lo"), F.max("end").alias("hi"), F.min_by(F.struct("kind", "action"), F.struct("start", "end", "kind")).alias("as"))
    put = F.when(F.col("as.action") == "remove", "").otherwise(F.concat(F.lit("["), F.upper("as.kind"), F.lit("]")))
    by_row = joined.select("row", "lo", "hi", put.alias("put")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "put"))).alias("cuts"))
    keyed = rows.join(by_row, "row").groupBy("id").agg(F.first("cuts").alias("cuts")).select(F.col("id.id").alias("of_id"), F.col("id.tag").alias("of_tag"), "cuts")
    both = whole.join(keyed, whole["key.id"].eqNullSafe(keyed["of_id"]) & (whole["key.tag"] == keyed["of_tag"]), "left")
    before = lambda i: F.when(i > 0, F.get("cuts", i - 1)["hi"]).otherwise(0)
    pieces = F.transform("cuts", lambda c, i: F.concat(F.substring(F.col("text"), before(i) + 1, c["lo"] - before(i)), c["put"]))
    last = F.substring("text", F.element_at("cuts", -1)["hi"] + 1, F.length("text"))
    clean = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), last))
    return both.select(*[(clean if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])
