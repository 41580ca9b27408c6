"""Personal data by patterns, and the terms that give it away, by information theory. DataFrame functions only.

Protected entities are e-mail addresses, IP addresses, card numbers and phone
numbers. A term is a word of letters; it stands near an entity if it lies whole
within ``WINDOW`` characters of it. Over the whole corpus,

    p(e)   is the share of words that stand near entity e,
    p(e|t) the share of the occurrences of term t that do, and
    d(t)   = PMI(t; e) / IC(e) = log(p(e|t) / p(e)) / log(1 / p(e)),

the largest over all entity values, and over their kinds, which count as entities
of a second level: the part of the information in "here is entity e" or "here is an
entity of this kind" that the term gives away, 1 if it never stands elsewhere. A
term is held against an entity or kind beside which it stands in at least
``SUPPORT`` different texts, so that copies of one text teach nothing. Near an
entity, terms from ``GENERALISE`` on are replaced by a general word, from
``REMOVE`` on they are removed; entities are replaced by their kind.

Words are counted for candidate terms only. Candidates and term spans are
broadcast if they are few, else joined by a shuffle; a hot term is
pre-aggregated in its task. Only rows near entities are ever shuffled, unless
very many documents hold disclosing terms.

Defined results: a null text has no spans and stays null; spans are in code
points, end excluded; entities of different kinds may overlap and are all listed,
their union is replaced once; term spans never overlap entities; repeated rows
get equal results, whatever their id; empty tables give no rows; other columns
pass through in the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortflow.llm.rows import ROW, text_of
from sortflow.plans.broadcasting import checked_broadcast
from sortflow.plans.once import computed_once
from sortflow.plans.workspace import materialise

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
WINDOW = 100
SUPPORT = 5
GENERALISE = 0.75
REMOVE = 0.9
MAX_TERMS = 200_000
MAX_MARKED = 200_000

_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"
#: Equal to the plain patterns, without going over a failed run of characters again.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_WORD = r"\p{L}{3,}"
_SPAN = "array<struct<start:int,kind:int,end:int,removed:boolean>>"
_NONE = "array<struct<start:int,piece:string>>"
#: Parts of a text that one array is appended to for; even, as every second part is a match.
_RUN = 64


def _pieces(text: Column, pattern: str) -> Column:
    """(start, piece) of all matches, leftmost and without overlap; starts are code points."""
    plain = F.when(text.rlike(f"[{_OPEN}{_CLOSE}]"), F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)).otherwise(text)
    parts = F.split(F.regexp_replace(plain, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)
    return _let(parts, _places)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(parts: Column) -> Column:
    """(start, piece) of every second part. Appending copies an array, so parts go by short runs, flattened at the end."""
    runs = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _RUN).cast("int"))
    of_run = lambda run: F.slice(parts, run * _RUN + 1, _RUN)
    lengths = F.transform(runs, lambda run: F.aggregate(of_run(run), F.lit(0), lambda n, part: n + F.char_length(part)))
    zero = F.array(F.lit(0))
    starts = F.aggregate(lengths, zero, lambda ends, n: F.concat(ends, F.array(F.element_at(ends, -1) + n)))

    def step(state: Column, part: Column) -> Column:
        piece = F.array(F.struct(state["at"].alias("start"), part.alias("piece")))
        return F.struct(
            (state["at"] + F.char_length(part)).alias("at"),
            (~state["inside"]).alias("inside"),
            F.when(state["inside"], F.concat(state["found"], piece)).otherwise(state["found"]).alias("found"),
        )

    def found(starts: Column) -> Column:
        def of(run: Column) -> Column:
            begin = F.struct(F.get(starts, run).alias("at"), F.lit(False).alias("inside"), F.array().cast(_NONE).alias("found"))
            return F.aggregate(of_run(run), begin, step, lambda state: state["found"])

        return F.flatten(F.transform(runs, of))

    return _let(starts, found)


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)

    def value(i: Column) -> Column:
        digit = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda sum_, i: sum_ + value(i))
    return total % 10 == 0


def _is_valid(kind: str, piece: Column) -> Column:
    digits = F.regexp_replace(piece, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return piece.rlike(r"^(0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\.|$)){4}$")
    if kind == "card":
        return F.when(F.char_length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.char_length(digits).between(9, 15)


def _spans_of(text: Column, number: int, kind: str) -> Column:
    pieces = F.filter(_pieces(text, _PATTERNS[kind]), lambda x: _is_valid(kind, x["piece"]))
    return F.transform(
        pieces,
        lambda x: F.struct(
            x["start"].alias("start"),
            F.lit(number).alias("kind"),
            (x["start"] + F.char_length(x["piece"])).alias("end"),
            F.lit(False).alias("removed"),
        ),
    )


def entity_spans(text: Column) -> Column:
    """All entities of a text, by start, kind and end."""
    found = []
    for number, kind in enumerate(KINDS):
        needed = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]"))
        found.append(F.when(needed, _spans_of(text, number, kind)).otherwise(F.array().cast(_SPAN)))
    return F.array_sort(F.concat(*found))


def _near(text: Column, span: Column) -> Column:
    """(start, piece) of the words near an entity, in lower case."""
    begin = F.greatest(span["start"] - WINDOW, F.lit(0))
    left = F.substr(text, begin + 1, span["start"] - begin)
    left = F.when(begin > 0, F.regexp_replace(left, r"^\p{L}+", " ")).otherwise(left)
    cut = F.when(begin > 0, F.char_length(F.regexp_extract(F.substr(text, begin + 1, span["start"] - begin), r"^(\p{L}+)", 1)))
    shift = begin + F.when(F.coalesce(cut, F.lit(0)) > 0, cut - 1).otherwise(0)
    right = F.regexp_replace(F.substr(text, span["end"] + 1, F.lit(WINDOW)), r"\p{L}+$", "")
    moved = lambda pieces, by: F.transform(pieces, lambda x: F.struct((x["start"] + by).alias("start"), x["piece"].alias("piece")))
    return F.concat(moved(_pieces(left, _WORD), shift), moved(_pieces(right, _WORD), span["end"]))


def _numbered(docs: DataFrame) -> list[str]:
    """Names for the columns of ``docs`` that no computed column has."""
    return [f"column_{i}" for i in range(len(docs.columns))]


def find_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(column_0 ..., text, place, entities): the columns of ``docs``, what tells a row apart, and its entities."""
    names = _numbered(docs)
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]
    rows = docs.select(*columns, text_of(docs, text_col).alias("text"), F.xxhash64("*").alias("place"))
    found = {"entities": entity_spans(F.coalesce("text", F.lit("")))}
    return computed_once(rows, [*names, "text", "place"], found)


def near_terms(found: DataFrame) -> DataFrame:
    """(place, said, kind, entity, start, end, term): every word near an entity, off all entities; ``said`` tells texts apart."""
    each = found.where(F.size("entities") > 0).select("place", "text", "entities", F.explode("entities").alias("span"))
    said = F.xxhash64("text").alias("said")
    entity = F.xxhash64("span.kind", F.substr("text", F.col("span.start") + 1, F.col("span.end") - F.col("span.start")))
    words = each.select(
        "place", said, "entities", F.col("span.kind").alias("kind"), entity.alias("entity"), F.explode(_near(F.col("text"), F.col("span"))).alias("word")
    )
    end = F.col("word.start") + F.char_length("word.piece")
    off = ~F.exists("entities", lambda x: (x["start"] < end) & (x["end"] > F.col("word.start")))
    return words.where(off).select(
        "place", "said", "kind", "entity", F.col("word.start").alias("start"), end.alias("end"), F.lower("word.piece").alias("term")
    )


def disclosing_terms(docs: DataFrame, near: DataFrame, text_col: str = "text", support: int = SUPPORT) -> DataFrame:
    """(term, disclosure) of the candidate terms: the part of an entity's information that they give away."""
    counts = F.count_distinct("place", "start").alias("near"), F.count_distinct("said").alias("texts")
    values = materialise(near.groupBy("term", "entity").agg(*counts), "pii-values")
    kinds = materialise(near.groupBy("term", "kind").agg(*counts), "pii-terms")
    enough = F.col("texts") >= support
    terms = values.where(enough).select("term").union(kinds.where(enough).select("term")).distinct()
    terms = materialise(terms.withColumn("candidate", F.lit(True)), "pii-candidates")
    if terms.isEmpty():
        return terms.select("term", F.lit(0.0).alias("disclosure"))
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_of(docs, text_col)), F.lit(f"({_WORD})"))).alias("term"))
    counted = words.join(checked_broadcast(terms, MAX_TERMS), "term", "left")
    counted = counted.groupBy(F.when(F.col("candidate"), F.col("term")).alias("term")).agg(F.count("*").alias("n"))
    counted = materialise(counted, "pii-counts")
    total = counted.agg(F.sum("n")).first()[0] or 1
    share = F.least(F.lit(0.5), F.col("all_near") / F.lit(total))
    degree = F.log(F.least(F.col("near") / F.col("n"), F.lit(1.0)) / share) / -F.log(share)

    def degrees(seen: DataFrame, what: str) -> DataFrame:
        whole = seen.groupBy(what).agg(F.sum("near").alias("all_near"))
        return seen.where(enough).join(whole, what).join(counted, "term").select("term", degree.alias("degree"))

    both = degrees(values, "entity").union(degrees(kinds, "kind"))
    return both.groupBy("term").agg(F.max("degree").alias("disclosure"))


def _disclosures(docs: DataFrame, text_col: str, support: int, generalise: float, remove: float) -> DataFrame:
    """The rows of :func:`find_entities` with their spans."""
    found = find_entities(docs, text_col)
    near = materialise(near_terms(found), "pii-near")
    terms = disclosing_terms(docs, near, text_col, support).where(F.col("disclosure") >= generalise)
    removed = (F.col("disclosure") >= remove).alias("removed")
    marks = near.join(terms, "term").select("place", F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", removed).alias("span"))
    marks = marks.groupBy("place").agg(F.collect_set("span").alias("terms"))
    marks = checked_broadcast(materialise(marks, "pii-marks"), MAX_MARKED)
    spans = F.array_sort(F.concat("entities", F.coalesce(F.col("terms").cast(_SPAN), F.array().cast(_SPAN))))
    return found.join(marks, "place", "left").withColumn("spans", spans)


def find_disclosures(
    docs: DataFrame,
    text_col: str = "text",
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """(row, text, entities, spans): every row as a struct, its entities, and entities and disclosing terms together."""
    found = _disclosures(docs, text_col, support, generalise, remove)
    row = F.struct(*[F.col(n).alias(c) for n, c in zip(_numbered(docs), docs.columns)])
    return found.select(row.alias(ROW), "text", "entities", "spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    said = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]))
    return F.array_join(said, ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with entities replaced by their kind, and disclosing terms replaced or removed."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)])
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        between = F.substr(text, state["at"] + 1, span["start"] - state["at"])
        said = F.when(span["removed"], F.lit("")).otherwise(F.element_at(names, span["kind"] + 1))
        out = F.when(span["start"] >= state["at"], F.concat(state["out"], between, said)).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substr(text, state["at"] + 1, F.char_length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, begin, step, finish)).otherwise(text)


def sanitise(
    docs: DataFrame,
    text_col: str = "text",
    length_col: str | None = None,
    support: int = SUPPORT,
    generalise: float = GENERALISE,
    remove: float = REMOVE,
) -> DataFrame:
    """``docs`` with sanitised texts; ``length_col`` gets their new length."""
    found = _disclosures(docs, text_col, support, generalise, remove)
    names = _numbered(docs)
    clean = computed_once(found, names, {"clean": sanitised(F.col("text"), F.col("spans"))})
    new = {text_col: F.col("clean")} | ({length_col: F.char_length("clean").cast("long")} if length_col else {})
    return clean.select(*[new.get(c, F.col(n)).alias(c) for n, c in zip(names, docs.columns)])
