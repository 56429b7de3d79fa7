"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them, and words nearby adjust the score. Places of
matches come from cutting the text at the same expression: the lengths of the pieces between matches and
of the matches add up to code-point offsets, summed in two levels so that a text with very many matches
costs little more than linear time.

All expressions are written so that the engine never steps back over long runs: possessive repeats, and
starts only where a run begins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightwatch.llm.registry import query
from flightwatch.llm.tables import table

#: Characters on either side of a span in which context words are looked for.
NEAR = 40
KEPT_FROM = 0.5


@dataclass(frozen=True)
class Kind:
    """``hint``: text that every match has, to leave out most texts. Score: ``base``, and ``context`` more
    if one of ``words`` is near. A kind with ``always`` stays whatever its score."""

    name: str
    pattern: str
    hint: str | None
    base: float
    context: float
    words: str
    always: bool = True


# The kinds, in the order in which spans at one place are listed.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         0.9, 0.1, "mail|contact|write|address"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, 0.3, "ip|host|server|address|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", None,
         0.7, 0.3, "card|visa|master|credit|debit|account|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, 0.3, "tel|phone|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])", None,
         0.7, 0.3, "iban|bank|account|transfer", always=False),
    Kind("ssn", r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])", "-",
         0.3, 0.4, "ssn|social security|tax id", always=False),
]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def luhn(digits: Column) -> Column:
    """Whether a string of at least one digit passes the Luhn check."""
    def doubled(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 1, F.when(n > 4, 2 * n - 9).otherwise(2 * n)).otherwise(n)
    return F.aggregate(F.transform(_chars(F.reverse(digits)), doubled), F.lit(0), lambda a, n: a + n) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97, its first four characters put last."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    return F.aggregate(_chars(turned), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        bare = F.regexp_replace(match, " ", "")
        return F.length(bare).between(15, 34) & mod97(bare)
    return F.lit(True)


def _placed(gaps: Column, hits: Column, block: int = 64) -> Column:
    """``start, end, match`` of each hit from the lengths of the pieces before it."""
    steps = F.transform(hits, lambda h, i: F.element_at(gaps, i + 1) + F.length(h))

    def sums(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def ends(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int"))
        of_block = F.transform(blocks, lambda b: sums(F.slice(s, b * block + 1, F.lit(block))))
        before = _let(of_block, lambda t: F.transform(t, lambda _, b: sums(F.slice(t, F.lit(1), b))))
        return _let(before, lambda f: F.transform(hits, lambda h, i: F.element_at(
            f, F.floor(i / block).cast("int") + 1) + sums(F.slice(
                s, F.floor(i / block).cast("int") * block + 1, i % block + 1))))

    return _let(_let(steps, ends), lambda e: F.transform(hits, lambda h, i: F.struct(
        (F.element_at(e, i + 1) - F.length(h)).alias("start"), F.element_at(e, i + 1).alias("end"), h.alias("match"))))


def pii_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``pii``: ``start, at, end, kind, score, match`` of each span, ordered
    by start, then by the order of kinds; offsets in code points, end exclusive.

    E-mail addresses, network addresses, card and phone numbers always stay once confirmed; account numbers
    must pass modulo 97, and identity numbers, which have no checksum, need a context word to reach KEPT_FROM.
    A null or empty text has none. Rows are treated one by one; an existing column ``pii`` is replaced,
    names beginning with ``_pii_`` are taken.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "pii"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(*keep, text.alias("_pii_text"))
    text = F.col("_pii_text")
    for i, k in enumerate(KINDS):
        some = text.rlike(k.pattern)
        step = step.withColumn(f"_pii_some{i}", F.contains(text, F.lit(k.hint)) & some if k.hint else some)
    cut = {}
    for i, k in enumerate(KINDS):
        # Both are null for most texts: they run only where the expression is known to match.
        cut[f"_pii_gaps{i}"] = F.when(F.col(f"_pii_some{i}"), F.transform(F.split(text, k.pattern, -1), lambda p: F.length(p)))
        cut[f"_pii_hits{i}"] = F.when(F.col(f"_pii_some{i}"), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)))
    step = step.withColumns(cut)

    def near(span: Column) -> Column:
        first = F.greatest(span["start"] - NEAR, F.lit(0))
        return F.lower(F.concat_ws(" ", F.substring(text, first + 1, span["start"] - first),
                                   F.substring(text, span["end"] + 1, F.lit(NEAR))))

    def of_kind(i: int, k: Kind) -> Column:
        spans = F.filter(_placed(F.col(f"_pii_gaps{i}"), F.col(f"_pii_hits{i}")), lambda s: _confirmed(k.name, s["match"]))
        scored = F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(i).alias("at"), s["end"].alias("end"), F.lit(k.name).alias("kind"),
            F.when(near(s).rlike(rf"\b(?:{k.words})"), k.base + k.context).otherwise(F.lit(k.base)).alias("score"),
            s["match"].alias("match")))
        kept = scored if k.always else F.filter(scored, lambda s: s["score"] >= KEPT_FROM)
        return F.when(F.col(f"_pii_some{i}"), kept)

    found = [of_kind(i, k) for i, k in enumerate(KINDS)]
    empty = F.array().cast("array<struct<start:int,at:int,end:int,kind:string,score:double,match:string>>")
    step = step.withColumn("_pii_any", F.concat(*[F.coalesce(f, empty) for f in found]))
    return step.select(*keep, F.array_sort("_pii_any").alias("pii"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets; spans that overlap become one, named by the
    first. Texts without spans, null ones included, stay as they are. ``length_col`` gets the new length."""
    spans = pii_spans(docs, text_col)
    merged = F.aggregate("pii", F.array().cast("array<struct<start:int,end:int,kind:string>>"), lambda a, s: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["end"] > s["start"]),
        F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(
            F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"),
            F.element_at(a, -1)["kind"].alias("kind"))))).otherwise(
        F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))))
    marked = spans.withColumn("_pii_runs", F.when(F.size("pii") > 0, merged))
    text, runs = F.col(text_col), F.col("_pii_runs")
    parts = F.transform(runs, lambda r, i: F.concat(
        _let(F.when(i > 0, F.element_at(runs, F.greatest(i, F.lit(1)))["end"]).otherwise(F.lit(0)),
             lambda at: F.substring(text, at + 1, r["start"] - at)),
        F.lit("["), F.upper(r["kind"]), F.lit("]")))
    clean = F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(runs, -1)["end"] + 1, F.length(text)))
    out = marked.withColumn(text_col, F.when(runs.isNotNull(), clean).otherwise(text))
    if length_col:
        out = out.withColumn(length_col, F.when(runs.isNotNull(), F.length(text_col).cast(docs.schema[length_col].dataType))
                             .otherwise(F.col(length_col)))
    return out.select(*docs.columns)


def _spans_sql() -> str:
    """SQL of the spans of ``documents``: a table ``found`` of doc_id, start, stop, at, kind."""
    # Plain forms of the same expressions; this engine has no look-around and needs none.
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
             "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+",
             "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
             "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
             "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"}
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn_sum = f"""list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i:
        CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END))"""
    bare = "replace(m, ' ', '')"
    rest97 = f"""list_reduce(list_concat([0], list_transform(string_split(substr({bare}, 5) || substr({bare}, 1, 4), ''),
        lambda c: ascii(c))), lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END)"""
    context = """regexp_matches(lower(substr(t, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)) || ' ' || substr(t, stop + 1, 40)),
        '\\b(?:%s)')"""
    test = {"email": "true", "ip": "len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR "
                                   "(len(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
            "card": f"CASE WHEN len({digits}) BETWEEN 12 AND 19 THEN {luhn_sum} % 10 = 0 ELSE false END",
            "phone": f"len({digits}) BETWEEN 9 AND 15",
            "iban": f"len({bare}) BETWEEN 15 AND 34 AND {rest97} = 1", "ssn": context % KINDS[5].words}
    parts = []
    for at, k in enumerate(KINDS):
        parts.append(f"""
SELECT doc_id, start, stop, {at} AS nth, '{k.name}' AS kind FROM (
  SELECT doc_id, t, m, stop - len(m) AS start, stop FROM (
    SELECT doc_id, t, hits[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda p: len(p))) + list_sum(list_transform(hits[1:i], lambda p: len(p))) AS BIGINT) AS stop
    FROM (SELECT doc_id, t, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, t, regexp_extract_all(t, '{plain[k.name]}') AS hits, string_split_regex(t, '{plain[k.name]}') AS gaps
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))))
WHERE {test[k.name]}""")
    return "found AS (" + " UNION ALL ".join(parts) + ")"


@query("op6_pii", f"""
WITH {_spans_sql()}, lines AS (
  SELECT doc_id, count(*) FILTER (nth = 0) AS n_email, count(*) FILTER (nth = 1) AS n_ip, count(*) FILTER (nth = 2) AS n_card,
         count(*) FILTER (nth = 3) AS n_phone,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) FILTER (nth < 4) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth) AS spans
  FROM (SELECT doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, nth, kind FROM found) GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN lines USING (doc_id)
""")
def op6_pii(spark, sf_dir):
    found = pii_spans(table(spark, sf_dir, "documents"), keep=["doc_id"])

    def n(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def lines(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("pii", lambda s: s["at"] < 4)
    return found.select("doc_id", n("email"), n("ip"), n("card"), n("phone"),
                        F.sha2(lines(base), 256).alias("base_sha256"), lines(F.col("pii")).alias("spans"))
