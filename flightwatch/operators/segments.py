"""Contiguous label segments and the joins that turn labels into row labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightwatch.operators.timeline import (
    CHUNK, KEYS, Prefix, chunk_seconds, join_facts, lane, row_number, settled, time_axis, with_halo, with_prefix, without_halo)


def segments(df: DataFrame, label: str = "label", reason: Column | None = None) -> DataFrame:
    """Maximal runs of equal label: start, end (start of the next run), label, reason.

    Only rows that open a run, and each flight's last row, go into the second pass.
    """
    has_reason = reason is not None or "reasons" in df.columns
    text = reason if reason is not None else (
        F.concat_ws("", F.transform("reasons", lambda t: F.concat(t, F.lit(";"))))
        if has_reason else F.lit(""))
    rows = df.select(*KEYS, *([CHUNK] if CHUNK in df.columns else []), "time_s",
                     F.col(label).alias("label"), text.alias("_reason"))
    halo = with_halo(rows, before=1, after=1, carry=["time_s", "label"])
    w = lane()
    previous = F.lag(F.struct("label")).over(w)
    marked = without_halo(halo.withColumns({
        "_opens": previous.isNull() | ~F.col("label").eqNullSafe(previous["label"]),
        "_closes": F.lead("time_s").over(w).isNull()}))
    events = with_halo(marked.filter("_opens OR _closes"), after=1, carry=["time_s"])
    ended = without_halo(events.withColumn("end_s", F.coalesce(F.lead("time_s").over(w), F.col("time_s"))),
                         drop_chunk=True)
    return (ended.filter("_opens")
            .select(*KEYS, F.col("time_s").alias("start_s"), "end_s", "label",
                    F.when(F.col("_reason") == "", F.lit("normal")).otherwise(F.col("_reason"))
                    .alias("reason")))


def label_number(label: Column) -> Column:
    """Hand-made segments may say "ignore" instead of 0 or 1."""
    return label.cast("string").try_cast("int")


def millis(time_s: Column) -> Column:
    """Log times have three decimals; whole milliseconds make them a safe join key."""
    return F.round(time_s * 1000).cast("long")


def attach_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join on flight and time; rows without a label are 0; old labels are replaced."""
    found = labels.select(*KEYS, millis(F.col("time_s")).alias("_ms"), F.col("label").alias("_found"))
    rows = df.drop("label").withColumn("_ms", millis(F.col("time_s")))
    return (rows.join(found, [*KEYS, "_ms"], "left").drop("_ms")
            .withColumn("label", F.coalesce(F.col("_found").cast("int"), F.lit(0))).drop("_found"))


def _cells(start: Column, end: Column, cell_s: float) -> Column:
    first = F.floor(start / F.lit(cell_s)).cast("long")
    return F.sequence(first, F.greatest(first, F.floor(end / F.lit(cell_s)).cast("long")))


#: Dyadic levels of a flight's boundaries: enough for 2^40 of them.
_LEVELS = 40


def _dyadic(first: Column, after: Column) -> Column:
    """The aligned nodes (level, number of its size) that make up the places first .. after - 1: two per level at most."""
    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        low, high = F.ceil(first / size), F.floor(after / size)
        node = lambda n, wanted: F.when((low < high) & wanted, F.struct(level.cast("int").alias("level"), n.cast("long").alias("node")))
        return F.array(node(low, low % 2 == 1), node(high - 1, high % 2 == 1))
    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), at)), lambda n: n.isNotNull())


def winning_stretches(segs: DataFrame, closed: str = "left", order: str = "start_s", keys: Sequence[str] = KEYS) -> DataFrame:
    """``time_s, won``: from that instant on, until the next one of the flight, the segment that is last by ``order``
    among those that hold has this label; 0 where none holds or its label is not a number.

    A segment costs two boundaries however long it is. Boundaries are numbered along the flight; between two of
    them the same segments hold. A segment is laid on the few aligned nodes that cover its numbers, each place asks
    the nodes above it, and the greatest answer wins: any depth of overlap, no list of open segments.
    """
    end = F.col("end_s").cast("double")
    # Closed segments end just after their last instant: at the next double.
    end = end if closed == "left" else end + F.greatest(F.abs(end) * (0.75 * 2.0 ** -52), F.lit(5e-324))
    held = settled(segs.select(*keys, F.col("start_s").cast("double").alias("_from"), end.alias("_to"), F.struct(
        F.col(order).alias("no"), F.col("start_s").alias("a"), F.col("end_s").alias("b"), label_number(F.col("label")).alias("v")).alias("_s"))
        .filter("_from < _to").distinct())
    edges = held.select(*keys, F.explode(F.array("_from", "_to")).alias("time_s")).distinct()
    numbered = settled(with_prefix(edges, {"_r": row_number()}, keys=keys).drop(CHUNK))
    most = numbered.agg(F.max("_r")).first()[0] or 1
    place = lambda name: numbered.withColumnsRenamed({"time_s": name, "_r": f"{name}_r"})
    spans = held.join(place("_from"), [*keys, "_from"]).join(place("_to"), [*keys, "_to"])
    nodes = (spans.select(*keys, "_s", F.explode(_dyadic(F.col("_from_r"), F.col("_to_r"))).alias("_n"))
             .groupBy(*keys, F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).agg(F.max("_s").alias("_s")))
    above = numbered.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(most.bit_length()))))
    above = above.withColumn("_node", F.expr("shiftright(_r, _level)"))
    return (above.join(nodes, [*keys, "_level", "_node"], "left").groupBy(*keys, "time_s")
            .agg(F.max("_s").alias("_s")).select(*keys, "time_s", F.coalesce("_s.v", F.lit(0)).alias("won")))


def _since(df: DataFrame, stretches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with ``won`` of the latest stretch that began at or before the row's time."""
    rows = df.withColumn("_asks", F.lit(1)).unionByName(stretches.withColumn("_asks", F.lit(0)), allowMissingColumns=True)
    known = F.when(F.col("_asks") == 0, F.col("won"))
    latest_won = Prefix(
        part=lambda at: F.max_by(known, F.when(known.isNotNull(), F.col("time_s"))),
        carry=lambda p, w: F.last(p, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        local=lambda w: F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        merge=lambda loc, car: F.coalesce(loc, car))
    carried = with_prefix(rows.withColumn("_at", F.struct("time_s", "_asks")), {"_won": latest_won}, order="_at", axis=time_axis(df), keys=keys)
    return carried.filter("_asks = 1").select(*df.columns, F.col("_won").alias("won"))


def labels_from_segments(df: DataFrame, segs: DataFrame, closed: str = "left", order: str = "start_s",
                         shared: bool = False) -> DataFrame:
    """Label of the last segment (by ``order``) holding the row's time, else 0.

    Segments become stretches that do not overlap (``winning_stretches``), and every row takes the latest one that
    has begun: one pass over rows and boundaries together, in chunks. ``shared`` segments hold for every flight;
    their boundaries are then copied to the chunks of time in which a flight has rows, with what holds at its start.
    """
    rows = df.drop("label")
    plain = rows.withColumnRenamed(CHUNK, "_chunk_before") if CHUNK in rows.columns else rows
    if not shared:
        stretches = winning_stretches(segs, closed, order)
    else:
        width = F.lit(chunk_seconds(df))
        whole = settled(winning_stretches(segs, closed, order, keys=()))
        met = settled(plain.select(*KEYS, time_axis(df).alias("_met")).distinct())
        starts = met.select("_met").distinct().withColumn("time_s", (F.col("_met") * width).cast("double"))
        opening_ = _since(starts, whole, keys=()).filter("won IS NOT NULL")
        inside = met.join(whole.withColumn("_met", time_axis(whole)), "_met")
        begun = met.join(opening_, "_met").join(whole.select("time_s").withColumn("_edge", F.lit(1)), "time_s", "left").filter("_edge IS NULL")
        stretches = inside.select(*KEYS, "time_s", "won").unionByName(begun.select(*KEYS, "time_s", "won"))
    labelled = _since(plain, stretches, KEYS).withColumn("label", F.coalesce(F.col("won"), F.lit(0))).drop("won")
    return labelled.withColumnRenamed("_chunk_before", CHUNK) if CHUNK in rows.columns else labelled


def windows_with_rows(windows: DataFrame, rows: DataFrame, cell_s: float = 4.0) -> DataFrame:
    """Per window: dominant mode, max failsafe and armed over rows in [start, end]; else null."""
    w = windows.select(*KEYS, "win", "start_s", "end_s",
                       F.explode(_cells(F.col("start_s"), F.col("end_s"), cell_s)).alias("_cell"))
    r = rows.select(*KEYS, F.floor(F.col("time_s") / F.lit(cell_s)).cast("long").alias("_cell"),
                    "time_s", "mode", "failsafe", "armed")
    facts = (w.join(r, [*KEYS, "_cell"]).filter("time_s BETWEEN start_s AND end_s")
             .groupBy(*KEYS, "win").agg(F.mode("mode", True).alias("dominant_mode"),
                                        F.max("failsafe").alias("failsafe"), F.max("armed").alias("armed")))
    return windows.join(facts, [*KEYS, "win"], "left")


def labelled_flights(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Only flights that have labels at all."""
    return join_facts(df, labels.select(*KEYS).distinct(), how="left_semi")


def flights_without(flights: DataFrame, partner: DataFrame) -> DataFrame:
    return flights.select(*KEYS).distinct().join(partner.select(*KEYS).distinct(), list(KEYS), "left_anti")


def stems_in_names(stems: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (stem, log_name) where the name contains the stem, without comparing all pairs.

    Every name is spread into its substrings of the lengths that stems have, and the
    substrings are matched by equality.
    """
    wanted = stems.select("stem").distinct().filter(F.length("stem") > 0)
    lengths = wanted.select(F.length("stem").alias("_len")).distinct()
    name = names.select("log_name").distinct().filter("log_name IS NOT NULL")
    longest = name.select("log_name", F.explode(F.sequence(F.lit(1), F.length("log_name"))).alias("_len"))
    sized = longest.join(lengths, "_len")
    cut = sized.select("log_name", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("log_name") - F.col("_len") + 1),
        lambda i: F.substring("log_name", i, F.col("_len")))).alias("stem"))
    return cut.distinct().join(wanted, "stem")


def resolve_labels(df: DataFrame, label_rows: DataFrame | None = None,
                   own_segments: DataFrame | None = None,
                   shared_segments: DataFrame | None = None) -> DataFrame:
    """Row labels from the best source of each flight, and ``label_source``.

    Order: label file with as many rows as the flight (matched by row position), column in
    the rows, the flight's own segments, shared segments, zeros. Sources missing for a
    flight give null and fall through.
    """
    from flightwatch.operators.windows import numbered
    rows = numbered(df.drop("rn", "n_rows"))
    sources: list[tuple[str, Column]] = []
    if label_rows is not None:
        placed = numbered(label_rows).select(*KEYS, "rn", F.col("label").alias("_from_file"),
                                             F.col("n_rows").alias("_file_rows"))
        rows = rows.join(placed, [*KEYS, "rn"], "left")
        sources.append(("file", F.when(F.col("_file_rows") == F.col("n_rows"), F.col("_from_file"))))
    inline = "label" in df.columns
    if inline:
        sources.append(("column", F.col("_inline")))
        rows = rows.withColumnRenamed("label", "_inline")
    for name, segs in (("segments", own_segments), ("shared", shared_segments)):
        if segs is None:
            continue
        if name == "shared":
            rows = labels_from_segments(rows, segs, shared=True).withColumnRenamed("label", "_from_shared")
            sources.append((name, F.col("_from_shared")))
            continue
        known = segs.select(*KEYS).distinct().withColumn("_has_own", F.lit(True))
        rows = join_facts(labels_from_segments(rows, segs).withColumnRenamed("label", "_from_segments"), known)
        sources.append((name, F.when(F.col("_has_own"), F.col("_from_segments"))))
    label = F.coalesce(*[c.cast("int") for _, c in sources], F.lit(0))
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in sources], F.lit("none"))
    return rows.select(*[c for c in df.columns if c != "label"],
                       label.alias("label"), source.alias("label_source"))


def mission_roots(names: DataFrame, column: str = "file_name") -> DataFrame:
    """One file per mission; repeated cleaning leaves several suffixes, the first name wins."""
    root = F.regexp_replace(F.col(column), "(_cleaned)+\\.csv$", "")
    w = Window.partitionBy("root").orderBy(column)
    return (names.withColumn("root", root).withColumn("_nth", F.row_number().over(w))
            .filter("_nth = 1").drop("_nth"))


# Allowed labels and reasons, shortest segment, largest gap.
SEGMENT_LABELS = [0, 1]
SEGMENT_REASONS = ["normal", "gps_spoof_synthetic"]
MIN_SEGMENT_S = 0.4
MAX_SEGMENT_GAP_S = 0.002


def check_segments(segs: DataFrame) -> DataFrame:
    """Violations per flight and check."""
    rows = segs.withColumn(CHUNK, time_axis(segs, "start_s"))
    halo = with_halo(rows, after=1, carry=["start_s"], order="start_s")
    gap = F.round(F.lead("start_s").over(lane("start_s")) - F.col("end_s"), 3)
    judged = without_halo(halo.withColumn("_gap", gap), drop_chunk=True)
    number = label_number(F.col("label"))
    bad = {
        "end_after_start": ~(F.col("end_s") > F.col("start_s")),
        "label_known": ~F.coalesce(number.isin(SEGMENT_LABELS), F.lit(False)),
        "reason_known": ~F.coalesce(F.col("reason").isin(SEGMENT_REASONS), F.lit(False)),
        "long_enough": ~(F.col("end_s") - F.col("start_s") >= MIN_SEGMENT_S),
        "contiguous": F.abs("_gap") > MAX_SEGMENT_GAP_S,
    }
    return tally(judged, bad)


def tally(judged: DataFrame, bad: dict[str, Column]) -> DataFrame:
    """One row (flight_id, check, violations) per flight and check, in one aggregation."""
    counts = judged.groupBy(*KEYS).agg(*[F.count_if(c).alias(f"_{n}") for n, c in bad.items()])
    return counts.select(*KEYS, F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(f"_{n}").alias("violations")) for n in bad])))
