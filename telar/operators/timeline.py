"""Dates, relative dates and durations in tender texts, as ordered events."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telar.functions.arrays import let
from telar.sources.files import settled

# Month names, the words of each event type in the order that breaks ties, anchor words, patterns of offsets and durations.
MONTHS = {
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10,
    "noviembre": 11, "diciembre": 12, "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9,
    "october": 10, "november": 11, "december": 12,
}
EVENT_WORDS = {
    "submission_deadline": ["entrega", "límite", "limite", "deadline", "vencimiento", "presentación", "presentacion", "oferta", "propuesta", "fecha límite", "fecha limite", "submission", "due date", "plazo de entrega", "cierre de recepción"],
    "qa_deadline": ["consultas", "preguntas", "q&a", "aclaraciones", "dudas", "questions", "queries", "rfi", "clarifications", "fecha de consultas", "periodo de preguntas"],
    "project_start": ["inicio", "comienza", "firma", "adjudicación", "adjudicacion", "arranque", "kickoff", "kick-off", "start", "beginning", "apertura", "suscripción", "suscripcion", "award"],
    "milestone": ["fase", "etapa", "entregable", "hito", "milestone", "phase", "stage", "deliverable", "sprint", "iteración"],
    "contract_end": ["fin", "término", "termino", "vencimiento del contrato", "vigencia", "end", "termination", "expiry", "finalización", "finalizacion", "conclusión", "conclusion"],
    "meeting": ["reunión", "reunion", "visita", "junta", "meeting", "site visit", "conferencia", "sesión", "sesion", "cita", "encuentro", "briefing"],
    "payment": ["pago", "factura", "payment", "invoice", "cobro", "abono", "desembolso"],
}
CRITICAL = ["submission_deadline", "qa_deadline"]
ANCHOR_WORDS = ["firma", "adjudicación", "adjudicacion", "contrato", "award", "signature"]
LABELS = [
    (["entrega", "presentación", "submission"], "Fecha de entrega: "), (["inicio", "start", "comienza"], "Inicio: "), (["fin", "término", "end"], "Finalización: "),
    (["reunión", "meeting", "visita"], "Reunión/Visita: "),
]
AFTER = "después|despues|post|tras|luego"
RELATIVE = [  # pattern, days for one of its units, the unit and the words that may follow it
    (rf"(\d+)\s*días?\s*(?:{AFTER})\s*(?:(?:de|del)\b)?\s*(.+)", 1, "día", AFTER),
    (r"(\d+)\s*días?\s*antes\s*(?:(?:de|del)\b)?\s*(.+)", -1, "día", "antes"),
    (rf"(\d+)\s*semanas?\s*(?:{AFTER})\s*(?:(?:de|del)\b)?\s*(.+)", 7, "semana", AFTER),
    (r"(\d+)\s*semanas?\s*antes\s*(?:(?:de|del)\b)?\s*(.+)", -7, "semana", "antes"),
    (rf"(\d+)\s*meses?\s*(?:{AFTER})\s*(?:(?:de|del)\b)?\s*(.+)", 30, "mese", AFTER),
    (r"al?\s*(?:los)?\s*(\d+)\s*días?\s*(?:de|del)\b\s*(.+)", 1, "día", r"del?\b"),
    (r"(\d+)\s*days?\s*(?:after|from|post)\s*(.+)", 1, "day", "after|from|post"),
    (r"(\d+)\s*days?\s*(?:before|prior to)\s*(.+)", -1, "day", "before|prior to"),
    (r"(\d+)\s*weeks?\s*(?:after|from|post)\s*(.+)", 7, "week", "after|from|post"),
    (r"(\d+)\s*weeks?\s*(?:before|prior to)\s*(.+)", -7, "week", "before|prior to"),
]
# what every relative expression holds; none of these contains another's digit, so one pass finds all
HEAD = r"(?U)\d\s*(?:" + "|".join(dict.fromkeys(rf"{unit}s?" for _, _, unit, _ in RELATIVE)) + r")\s*(?:" + "|".join(dict.fromkeys("|".join(words for _, _, _, words in RELATIVE).split("|"))) + ")"
DURATIONS = [
    r"duraci[oó]n\s*(?:de|del|:)?\s*(\d+)\s*(días|dias|semanas|meses|años|anos)", r"(?:durar[aá]|vigencia\s*(?:de)?)\s*(\d+)\s*(días|dias|semanas|meses|años|anos)",
    r"(\d+)\s*(días|dias|semanas|meses|años|anos)\s*de\s*(?:duración|vigencia)", r"duration\s*(?:of|:)?\s*(\d+)\s*(days|weeks|months|years)",
    r"(\d+)\s*(days|weeks|months|years)\s*(?:duration|term)",
]
DURATION_WORDS = [["duraci"], ["durar", "vigencia"], ["duración", "vigencia"], ["duration"], ["duration", "term"]]  # of each pattern, one of which its matches hold
UNIT_DAYS = {"días": 1, "dias": 1, "days": 1, "semanas": 7, "weeks": 7, "meses": 30, "months": 30, "años": 365, "anos": 365, "years": 365}

NAMES = "|".join(MONTHS)
INITIALS = "".join(sorted({m[0] for m in MONTHS}))  # a cheap look at one character comes before the boundary, then three letters of a month; other scripts pass
DATE = (
    rf"(?iU)(?-iU:(?=[{INITIALS}{INITIALS.upper()}0-9\x{{80}}-\x{{10FFFF}}]))\b(?=\d|(?:{'|'.join(sorted({m[:3] for m in MONTHS}))}))"
    rf"(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{4}}|\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}\s+(?:de\s+)?(?:{NAMES})(?:,?\s+(?:(?:de|del)\s+)?\d{{4}})?"
    rf"|(?:{NAMES})\s+\d{{1,2}},?\s+\d{{4}}|(?:{NAMES})\s+(?:(?:de|del)\s+)?\d{{4}})\b")


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def month_number(match: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(match, rf"(?i)({NAMES})", 1)))


def parse_date(match: Column, anchor: Column) -> Column:
    """Struct of date and year_inferred; null date where the numbers make none."""
    part = lambda p, g=1: F.regexp_extract(match, p, g)
    build = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d")
    has_year, month = match.rlike(r"\d{4}"), month_number(match).cast("string")
    year = F.when(has_year, part(r"(\d{4})")).otherwise(F.year(anchor).cast("string"))
    day_of = F.when(match.rlike(r"(?<!\d)\d{1,2}(?!\d)"), part(r"(?<!\d)(\d{1,2})(?!\d)")).otherwise("1")
    plain = (
        F.when(match.rlike(r"^\d{4}-"), build(part(r"^(\d+)-(\d+)-(\d+)$"), part(r"^(\d+)-(\d+)-(\d+)$", 2), part(r"^(\d+)-(\d+)-(\d+)$", 3)))
        .when(match.rlike(r"^\d+[/-]"), build(part(r"(\d+)[/-](\d+)[/-](\d+)", 3), part(r"(\d+)[/-](\d+)[/-](\d+)", 2), part(r"(\d+)[/-](\d+)[/-](\d+)", 1)))
        .otherwise(build(year, month, day_of)))
    bound = lambda p: F.when(~has_year & (p < anchor), F.add_months(p, 12)).otherwise(p)
    return F.struct(let(plain, bound).alias("date"), (~has_year).alias("inferred"))


def context_window(text: Column, target: Column, window: int = 50, low: Column | None = None) -> Column:
    """Up to `window` characters on either side of the target's first occurrence, any case; low: the text in lower case, where it is at hand."""
    def cut(at: Column) -> Column:
        a = F.greatest(at - window, F.lit(1))
        return F.when(at > 0, F.trim(F.substring(text, a, at + F.length(target) + window - a))).otherwise("")

    return let(F.position(F.lower(target), F.lower(text) if low is None else low), cut)


def describe(original: Column, low: Column) -> Column:
    """low: the context in lower case, a column of its own, as many words are looked up in it."""
    out = F.lit("Evento: ")
    for words, label in reversed(LABELS):
        out = F.when(any_of(low, words), label).otherwise(out)
    return F.concat(out, original)


def classify(low: Column) -> Column:
    """The type with most of its words in original and description; ties go to the earlier type, none to other. low: both in lower case, a column of its own."""
    count = lambda words: reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in words])
    other = F.struct(F.lit(0).alias("n"), F.lit(1).alias("o"), F.lit("other").alias("t"))
    return F.array_max(F.array(other, *[F.struct(count(words).alias("n"), F.lit(-i).alias("o"), F.lit(t).alias("t")) for i, (t, words) in enumerate(EVENT_WORDS.items())]))["t"]


def valid_anchor(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


EVENT = "array<struct<seq:int,original:string,event_date:date,confidence:double,offset_days:int,dependency:string,is_relative:boolean>>"


def dated(text: Column, anchor: Column) -> Column:
    """Date expressions as EVENT structs; seq counts all matches."""
    def event(m: Column, i: Column) -> Column:
        p = parse_date(m, anchor)
        return F.struct(
            i.alias("seq"), m.alias("original"), p["date"].alias("event_date"), F.when(p["inferred"], 0.7).otherwise(0.9).alias("confidence"), F.lit(None).cast("int").alias("offset_days"),
            F.lit(None).cast("string").alias("dependency"), F.lit(False).alias("is_relative"))

    found = F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), event)
    return F.filter(found, lambda x: (F.length(x["original"]) >= 4) & x["event_date"].isNotNull()).cast(EVENT)


def relative(low: Column) -> Column:
    """Relative expressions of a text in lower case as EVENT structs, pattern by pattern; seq begins at 100,000.

    One pass finds the heads: number, unit and word. A pattern is tried where a head is its own; its groups are taken from the match.
    """
    none = F.array().cast("array<struct<original:string,offset_days:int,dependency:string>>")

    def matches(heads: Column, p: str, days: int, unit: str, words: str) -> Column:
        part = lambda m, g: F.regexp_extract(m, "(?U)" + p, g)
        event = lambda m: F.struct(m.alias("original"), (part(m, 1).try_cast("int") * days).alias("offset_days"), F.trim(part(m, 2)).alias("dependency"))
        holds = heads.contains(unit) & heads.rlike(rf"(?U){unit}s?\s*(?:{words})")
        return F.when(holds, F.transform(F.regexp_extract_all(low, F.lit("(?U)" + p), F.lit(0)), event)).otherwise(none)

    found = let(F.array_join(F.regexp_extract_all(low, F.lit(HEAD), F.lit(0)), "\n"), lambda heads: F.when(heads == "", none).otherwise(F.concat(*[matches(heads, *r) for r in RELATIVE])))
    return F.transform(found, lambda x, i: F.struct(
        (i + 100_000).alias("seq"), x["original"].alias("original"), F.lit(None).cast("date").alias("event_date"), F.lit(0.8).alias("confidence"), x["offset_days"].alias("offset_days"),
        x["dependency"].alias("dependency"), F.lit(True).alias("is_relative"))).cast(EVENT)


def absolute_dates(docs: DataFrame, anchor: Column) -> DataFrame:
    """doc_id, text, seq, original, event_date, confidence of every date expression; docs: doc_id, text."""
    return docs.select("doc_id", "text", F.inline(dated(F.col("text"), anchor))).select("doc_id", "text", "seq", "original", "event_date", "confidence")


def relative_dates(docs: DataFrame) -> DataFrame:
    """doc_id, text, seq, original, offset_days, dependency of every relative expression, pattern by pattern."""
    return docs.select("doc_id", "text", F.lower("text").alias("low")).select("doc_id", "text", F.inline(relative(F.col("low")))).select("doc_id", "text", "seq", "original", "offset_days", "dependency")


def spans(low: Column) -> Column:
    """Durations of a text in lower case as structs of original, value, unit and days, pattern by pattern.

    A pattern is tried once, where its words stand in the text; its groups are taken from the match.
    """
    table = F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv])

    def matches(p: str, words: list[str]) -> Column:
        def span(m: Column) -> Column:
            value, unit = F.regexp_extract(m, p, 1).try_cast("int"), F.regexp_extract(m, p, 2)
            return F.struct(m.alias("original"), value.alias("value"), unit.alias("unit"), (value * table[unit]).alias("days"))

        return F.transform(F.when(any_of(low, words), F.regexp_extract_all(low, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")), span)

    return F.concat(*[matches(p, words) for p, words in zip(DURATIONS, DURATION_WORDS)])


def durations(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.lower("text").alias("low")).select("doc_id", F.inline(spans(F.col("low"))))


def project_duration(found: DataFrame) -> DataFrame:
    per = found.groupBy("doc_id").agg(F.max("days").alias("days"))
    return per.withColumn("months", F.bround(F.col("days") / 30, 1))


def events(docs: DataFrame, anchor: Column) -> DataFrame:
    """All events of the documents, described and classified; relative ones not yet resolved. One scan, no shuffle; further columns stay."""
    more, text = [c for c in docs.columns if c not in ("doc_id", "text", "low_")], F.col("text")
    out = docs if "low_" in docs.columns else docs.withColumn("low_", F.lower("text"))
    out = out.select("doc_id", *more, "text", "low_", F.inline(F.concat(dated(text, anchor), relative(F.col("low_")))))
    out = out.withColumn("context_", F.lower(context_window(text, F.col("original"), low=F.col("low_")))).drop("text", "low_")
    out = out.withColumn("description", describe(F.col("original"), F.col("context_"))).drop("context_")
    out = out.withColumn("words_", F.lower(F.concat_ws(" ", "original", "description")))
    out = out.withColumn("event_type", classify(F.col("words_"))).drop("words_")
    return out.withColumn("is_critical", F.col("event_type").isin(*CRITICAL))


FEW = 32  # events of a document that are compared one by one


class FirstHolding:
    """For each of some texts, the day of the first description that holds it, as descriptions come.

    An automaton of all texts finds those that a description holds in one pass over it.
    """

    def __init__(self, texts: set[str]):
        import ahocorasick

        self.day: dict[str, int] = {}
        self.every = ahocorasick.Automaton()
        for t in texts:
            self.every.add_word(t, t)
        self.every.make_automaton()

    def add(self, description: str, day: int) -> None:
        for _, t in self.every.iter(description):
            self.day.setdefault(t, day)


def follow(asked: list, offset: list, day: list, low: list) -> None:
    """Sets the days of one document's rows that ask for an earlier event, in their order."""
    index = FirstHolding({t for t in asked if t}) if len(asked) > FEW else None
    for i, t in enumerate(asked):
        if t:
            first = index.day.get(t) if index else next((day[j] for j in range(i) if day[j] is not None and t in low[j]), None)
            day[i] = first + offset[i] if first is not None and abs(first + offset[i]) < 1 << 31 else None
        if index and day[i] is not None and low[i]:
            index.add(low[i], day[i])


def opened(found: DataFrame, anchor: str) -> DataFrame:
    """found with asked_ (what an event looks for in earlier ones) and low_ (its description in lower case); days counted from the anchor are set."""
    base, dep = F.lit(datetime.date.fromisoformat(anchor)), F.lower("dependency")
    asks = F.coalesce(F.col("is_relative") & (dep != "") & F.col("offset_days").isNotNull(), F.lit(False))
    at_anchor = F.when(any_of(dep, ANCHOR_WORDS), F.date_add(base, F.col("offset_days")))
    return found.withColumns({
        "asked_": F.when(asks & ~any_of(dep, ANCHOR_WORDS), dep), "low_": F.lower("description"), "event_date": F.when(asks, at_anchor).otherwise(F.col("event_date"))})


def whole_documents(batches):
    """Tables of whole documents from batches in which a document's rows (doc_id first) come together."""
    import pyarrow as pa

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        doc = table.column("doc_id").to_pylist()
        last = len(doc)
        while last and doc[last - 1] == doc[-1]:
            last -= 1
        if last:
            yield table.slice(0, last)
        held = table.slice(last)
    if held is not None and len(held):
        yield held


def followed(table):
    """The days of the rows of a table of whole documents, and where documents begin and end."""
    import pyarrow as pa

    doc = table.column("doc_id").to_pylist()
    asked, offset, low = (table.column(c).to_pylist() for c in ("asked_", "offset_days", "low_"))
    day = table.column("event_date").cast(pa.int32()).to_pylist()
    cut = [0, *(i for i in range(1, len(doc)) if doc[i] != doc[i - 1]), len(doc)]
    for a, z in zip(cut, cut[1:]):
        if any(asked[a:z]):
            own = day[a:z]
            follow(asked[a:z], offset[a:z], own, low[a:z])
            day[a:z] = own
    return pa.array(day, pa.int32()), cut


def resolve(found: DataFrame, anchor: str) -> DataFrame:
    """Dates of relative events: from the anchor if the dependency names the award, else from the first earlier dated event
    of the document whose description holds the dependency; chains resolve in order. Others stay open.

    Events are dealt by document and sorted, once; a task reads them in order and keeps one document's events at a time, with
    an index of the texts that its events depend on, so that a long document costs in proportion to its length.
    """
    names = [c for c in found.columns if c not in ("doc_id", "seq")]
    dealt = opened(found, anchor).repartition("doc_id").sortWithinPartitions("doc_id", "seq", *names).select(*found.columns, "asked_", "low_")
    columns = found.columns

    def run(batches):
        for table in whole_documents(batches):
            dates = table.schema.get_field_index("event_date")
            table = table.set_column(dates, "event_date", followed(table)[0].cast(table.column(dates).type))
            yield from table.select(columns).combine_chunks().to_batches()

    return dealt.mapInArrow(run, found.schema)


def keep_confident(found: DataFrame, least: float = 0.5) -> DataFrame:
    return found.filter(F.col("confidence") >= least)


def in_order(found: DataFrame) -> DataFrame:
    """place: 1, 2, … per document by date, open ones last."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("event_date").asc_nulls_last(), "seq")))


def split_events(found: DataFrame) -> DataFrame:
    names = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("seq", "original")))), lambda x: x["original"])
    per = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_events"), names(F.col("is_critical")).alias("critical"), names(F.col("event_date").isNull()).alias("unresolved"))
    warn = F.when(F.size("unresolved") > 0, F.format_string("%d evento(s) sin fecha", F.size("unresolved")))
    return per.withColumn("warning", warn)


def next_deadline(found: DataFrame, day: Column) -> DataFrame:
    ahead = found.filter(F.col("is_critical") & (F.col("event_date") >= day))
    return ahead.groupBy("doc_id").agg(F.min(F.struct("event_date", "seq", "description")).alias("m")).select("doc_id", "m.event_date", "m.description")


def table_rest(description: Column, kind: Column) -> Column:
    """A line of the table after its date."""
    return F.concat(F.lit(" | "), description, F.lit(" | "), kind, F.lit(" | "), F.when(kind.isin(*CRITICAL), "⚠️").otherwise(""), F.lit(" |"))


def page(days: Column, rests: Column, months: Column, anchor: str) -> Column:
    lines = F.zip_with(days, rests, lambda d, r: F.concat(F.lit("| "), F.coalesce(d.cast("string"), F.lit("TBD")), r))
    head = F.array(
        F.lit("## Cronograma del Proyecto"), F.lit(""), F.lit(f"**Fecha base**: {anchor}"), F.concat(F.lit("**Duración estimada**: "), F.coalesce(months.cast("string"), F.lit("N/D")), F.lit(" meses")), F.lit(""),
        F.lit("| Fecha | Evento | Tipo | Crítico |"), F.lit("|-------|--------|------|---------|"))
    return F.array_join(F.concat(head, lines), "\n")


def report(found: DataFrame, months: DataFrame, anchor: str) -> DataFrame:
    """Markdown timeline per document, of resolved events."""
    row = F.struct("place", F.col("event_date").alias("day"), table_rest(F.col("description"), F.col("event_type")).alias("rest"))
    per = in_order(found).groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("r")).join(months, "doc_id", "left")
    return per.select("doc_id", page(F.col("r.day"), F.col("r.rest"), F.col("months"), anchor).alias("report"))


def lined(batches):
    """Of events in the order of their rows, a document's together: doc_id, days (a duration), day and rest, the last two in the order of the table."""
    import numpy as np
    import pyarrow as pa

    for table in whole_documents(batches):
        day, cut = followed(table)
        doc, number = np.repeat(np.arange(len(cut) - 1), np.diff(cut)), day.fill_null(0).to_numpy()
        order = pa.array(np.lexsort((table.column("seq").to_numpy(), number, day.is_null().to_numpy(zero_copy_only=False), doc)))
        ends, first = pa.array(cut, pa.int32()), table.take(pa.array(cut[:-1])).combine_chunks()
        lists = [pa.ListArray.from_arrays(ends, x.take(order)) for x in (day.cast(pa.date32()), table.column("rest").combine_chunks())]
        yield pa.RecordBatch.from_arrays([first.column(c).combine_chunks() for c in ("doc_id", "days")] + lists, names=["doc_id", "days", "day", "rest"])


def reports(docs: DataFrame, anchor: str) -> DataFrame:
    """report() of documents (doc_id, text). One that comes in a single row is done where it stands: only ids are shuffled, to know
    those of several rows, which are dealt by document."""
    again = settled(docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("again")), "repeated")
    alone, several = docs, again.limit(1).count()
    if several:
        alone = docs.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left_anti")
    rows = alone.select("doc_id", "text", F.lower("text").alias("low_"))
    rows = rows.withColumn("days", F.array_max(F.transform(spans(F.col("low_")), lambda x: x["days"])))
    found = opened(events(rows, F.lit(anchor).cast("date")), anchor).withColumn("rest", table_rest(F.col("description"), F.col("event_type")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = found.select("doc_id", "days", "seq", "event_date", "offset_days", "asked_", F.when(F.col("asked_").isNotNull() | F.col("event_date").isNotNull(), F.col("low_")).otherwise("").alias("low_"), "rest")
    out = found.mapInArrow(lined, f"doc_id {kind}, days int, day array<date>, rest array<string>")
    out = out.select("doc_id", page(F.col("day"), F.col("rest"), F.bround(F.col("days") / 30, 1), anchor).alias("report"))
    if several:
        parts = docs.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left_semi")
        out = out.unionByName(report(resolve(events(parts, F.lit(anchor).cast("date")), anchor), project_duration(durations(parts)), anchor))
    return out
