"""A2 for large files: a CSV with line breaks inside quotes, read by as many tasks as a text
file without them would be.

Spark deals a text file into byte ranges and hands each line to one of them. Whether a line
begins inside a quoted field is told by the number of quotes before it, so

1. one pass counts the quotes of every range, and a running sum over the ranges of a file says
   which ranges begin inside quotes;
2. each range then puts its lines together to records on its own, Arrow batch by Arrow batch,
   and gives up only what began before it (its head) and what it cannot finish (its tail);
3. heads and tails, at most two a range, are stitched in the order of the ranges;
4. the records are parsed by Spark's own CSV parser.

If no range begins inside quotes, steps 2 and 3 have nothing to stitch and cost no pass.

Quotes must be doubled inside quoted fields and balanced within a record, as ``write_csv`` and
every writer after RFC 4180 do it. A record of several lines that is not so, and a file whose
quotes do not pair up, fail the read instead of being misread; ``split=False`` of ``read_csv``
reads such a file in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pagoscope.sources.checkpoint import written

HEAD, TAIL = 0, 1
# every field is free of quotes, or quoted with its own quotes doubled
WELL_FORMED = r'\A(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*\r?\z'
_BOM = "\ufeff"


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, line): the lines of the files, each in the byte range that holds it."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"),
    )


def ranges_inside_quotes(lines: DataFrame) -> DataFrame:
    """(file, start) of the ranges that begin inside a quoted field; ``file`` is a hash of the
    path. Raises where the quotes of a file do not pair up."""
    counted = lines.groupBy("path", "start").agg(
        F.sum(F.expr("octet_length(line) - octet_length(replace(line, '\"', ''))")).alias("quotes")
    )
    # a row per range; the order of a file's ranges is the order of their first bytes
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(
        counted.select(
            "path", F.xxhash64("path").alias("file"), "start", "quotes",
            F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("before"),
        ),
        "csv_ranges",
    )
    files = ranges.groupBy("path", "file").agg((F.sum("quotes") % 2).alias("open"))
    odd = files.where("open = 1").select("path").limit(3).collect()
    if odd:
        raise ValueError(f"quotes are not balanced in {', '.join(r.path for r in odd)}; read with split=False")
    if not files.groupBy("file").count().where("count > 1").isEmpty():
        raise ValueError("two files share a path hash; read them one by one")
    return ranges.where("before % 2 = 1").select("file", "start")


class _Range:
    """The lines of one range on their way to records."""

    def __init__(self, key: tuple[int, int], inside: bool) -> None:
        self.key, self.inside = key, inside
        self.begun_before = inside   # its first piece belongs to an earlier range
        self.is_first = key[1] == 0  # its first record is the file's header
        self.open: list = []         # lines of the record that is not finished yet

    def add(self, lines):
        """Finished pieces (strings, in order) of this record and the lines so far."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
        after = (np.cumsum(quotes) + self.inside) % 2
        ends = np.flatnonzero(after == 0)
        self.inside = bool(after[-1])
        if not len(ends):
            self.open.append(lines)
            return None
        whole, rest = lines.slice(0, ends[-1] + 1), lines.slice(ends[-1] + 1)
        if len(ends) < len(whole):
            starts = pa.array(np.concatenate([[0], ends + 1]), pa.int32())
            plain = pa.concat_arrays([whole.cast(pa.string())])
            whole = pc.binary_join(pa.ListArray.from_arrays(starts, plain), "\n")
        if self.open:
            first = "\n".join([*self._open_lines(), whole[0].as_py()])
            whole = pa.concat_arrays([pa.array([first], pa.string()), whole.slice(1).cast(pa.string())])
        self.open = [rest] if len(rest) else []
        return whole

    def _open_lines(self) -> list[str]:
        return [line for part in self.open for line in part.to_pylist()]

    def tail(self) -> str | None:
        return "\n".join(self._open_lines()) if self.open else None


def _check(records) -> None:
    import pyarrow.compute as pc

    several = records.filter(pc.match_substring(records, "\n"))
    if len(several):
        bad = several.filter(pc.invert(pc.match_substring_regex(several, WELL_FORMED)))
        if len(bad):
            raise ValueError(f"a quote stands inside an unquoted field near {bad[0].as_py()[:200]!r}; read with split=False")


def _ranges(batches: Iterator, inside: set[tuple[int, int]]) -> Iterator[tuple[_Range, object, bool]]:
    """(range, finished pieces or None, whether the range ends here)."""
    import numpy as np

    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file = batch.column("file").to_numpy(zero_copy_only=False)
        start = batch.column("start").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = int(file[low]), int(start[low])
            if current is None or current.key != key:
                if current is not None:
                    yield current, None, True
                current = _Range(key, key in inside)
            yield current, current.add(batch.column("line").slice(low, high - low)), False
    if current is not None:
        yield current, None, True


def _records(lines: DataFrame, inside: set[tuple[int, int]]) -> DataFrame:
    """(is_first, record) of the records that lie in one range."""

    def assemble(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, pieces, _ in _ranges(batches, inside):
            if pieces is None:
                continue
            if part.begun_before:
                part.begun_before, pieces = False, pieces.slice(1)
            if not len(pieces):
                continue
            _check(pieces)
            first = [False] * len(pieces)
            first[0], part.is_first = part.is_first, False
            yield pa.RecordBatch.from_arrays([pa.array(first), pieces.cast(pa.string())], names=["is_first", "record"])

    return lines.mapInArrow(assemble, "is_first boolean, record string")


def _stitched(lines: DataFrame, inside: set[tuple[int, int]]) -> DataFrame:
    """(is_first, record) of the records that cross a range's end."""

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part, done, ends in _ranges(batches, inside):
            rows = []
            if done is not None and len(done):
                if part.begun_before:
                    rows.append((HEAD, False, done[0].as_py()))
                part.is_first = part.is_first and part.begun_before and len(done) == 1
                part.begun_before = False
            if ends and (text := part.tail()) is not None:
                rows.append((HEAD if part.begun_before else TAIL, part.is_first, text))
            if rows:
                side, first, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.key[0]] * len(rows)), pa.array([part.key[1]] * len(rows)),
                     pa.array(side, pa.int32()), pa.array(first), pa.array(text, pa.string())],
                    names=["file", "start", "side", "is_first", "text"],
                )

    found = written(
        lines.mapInArrow(pieces, "file long, start long, side int, is_first boolean, text string"), "csv_pieces"
    )
    # a tail begins a record; the heads up to the next tail go on with it
    order = Window.partitionBy("file").orderBy("start", "side")
    chains = found.select("file", "start", "side", F.sum("side").over(order).alias("chain"))
    joined = found.join(chains, ["file", "start", "side"]).groupBy("file", "chain").agg(
        F.array_sort(F.collect_list(F.struct("start", "side", "text"))).alias("parts"),
        F.bool_or("is_first").alias("is_first"),
    )

    def checked(batches: Iterator) -> Iterator:
        for batch in batches:
            _check(batch.column("record"))
            yield batch

    return written(
        joined.select("is_first", F.expr("array_join(parts.text, '\\n')").alias("record"))
        .mapInArrow(checked, "is_first boolean, record string"),
        "csv_stitched",
    )


def records_of(spark: SparkSession, path: str) -> DataFrame:
    """(is_first, record): the records of the CSV files as text; ``is_first`` marks headers."""
    lines = lines_of(spark, path)
    inside = {(r.file, r.start) for r in ranges_inside_quotes(lines).collect()}
    narrow = lines.select(F.xxhash64("path").alias("file"), "start", "line")
    records = _records(narrow, inside)
    return records.unionByName(_stitched(narrow, inside)) if inside else records


def read(spark: SparkSession, path: str, names: list[str], options: dict[str, str]) -> DataFrame:
    """The text columns ``names`` of the CSV files below ``path``; a file with another header
    fails the read."""
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    schema = ", ".join(f"{n} STRING" for n in quoted)
    parser = {k: v for k, v in options.items() if k != "header"}
    header = F.array(*[F.col(f"_row.{n}") for n in quoted])
    expected = F.array(*[F.lit(n) for n in names])
    rows = records_of(spark, path).where("record <> ''").select(
        "is_first",
        F.from_csv(F.when(F.col("is_first"), F.ltrim(F.col("record"), F.lit(_BOM))).otherwise(F.col("record")),
                   schema, parser).alias("_row"),
    )
    is_row = F.when(~F.col("is_first"), F.lit(True)).when(header == expected, F.lit(False)).otherwise(
        F.raise_error(F.lit(f"a CSV file below {path} does not have the header {', '.join(names)}")).cast("boolean")
    )
    return rows.where(is_row).select("_row.*")
