"""Official files: a catalogue with required and optional stems, validated as it is read; an inventory; bounded blocks."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.operators.contracts import game_contract, repeated
from fieldglass.operators.joins import require_empty
from fieldglass.schema import SCHEMAS
from fieldglass.sources.files import list_files

REQUIRED = ["RegularSeasonCompactResults", "RegularSeasonDetailedResults", "NCAATourneyCompactResults", "NCAATourneySeeds"]
OPTIONAL = ["TeamCoaches", "TeamConferences"]
BOX = ["FGM", "FGA", "FGM3", "FGA3", "FTM", "FTA", "OR", "DR", "TO"]
SEED = r"^[WXYZ](0[1-9]|1[0-6])[ab]?$"


def read_official(spark: SparkSession, folder: str, check: bool = True) -> dict[str, DataFrame]:
    """Stem -> frame of both populations' files with ``Gender``: four required stems each and two optional ones.

    Types are declared, malformed rows fail the read, games and seeds must hold their contracts, and ``seed`` is the
    number in a seed's code. Missing required files are an error that names them all.
    """
    have = {p.rsplit("/", 1)[-1].removesuffix(".csv"): p for p in list_files(spark, folder, ".csv")}
    gone = [f"{g}{s}.csv" for g in "MW" for s in REQUIRED if f"{g}{s}" not in have]
    if gone:
        raise FileNotFoundError(f"missing official files: {', '.join(gone)}")
    out = {}
    for stem in [*REQUIRED, *OPTIONAL]:
        for g in "MW":
            if g + stem not in have:
                continue
            t = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(SCHEMAS[stem]).csv(have[g + stem]).withColumn("Gender", F.lit(g))
            out[stem] = t if stem not in out else out[stem].unionByName(t)
    seeds = out["NCAATourneySeeds"]
    out["NCAATourneySeeds"] = seeds.withColumn("seed", F.nullif(F.regexp_extract("Seed", SEED, 1), F.lit("")).cast("double"))
    if check:
        for stem in REQUIRED[:3]:
            for g in "MW":
                require_empty(game_contract(out[stem].where(F.col("Gender") == g), BOX if "Detailed" in stem else ()), f"{g}{stem}")
        require_empty(out["NCAATourneySeeds"].where("seed is null or TeamID is null or Season is null"), "a seed's code is invalid")
        require_empty(repeated(seeds, ["Gender", "Season", "TeamID"], "repeated"), "a team is seeded twice")
    return out


def inventory(spark: SparkSession, folder: str, suffix: str = ".csv", encoding: str = "ISO-8859-1") -> DataFrame:
    """file, bytes, sha256, rows, place, column, missing, low, high: a row a column of a folder's CSV files (of one without a
    header one row, without a column). ``low`` and ``high`` are of the values as text. A file streams through one task, so
    it may be of any size, and quoted newlines are part of their record."""
    from fieldglass.sources.members import _store

    def run(batches):
        import hashlib

        import pyarrow as pa

        class Counted(io.RawIOBase):
            """A stream that digests and counts what is read of it."""

            def __init__(self, raw):
                self.raw, self.size, self.hash = raw, 0, hashlib.sha256()

            def readable(self):
                return True

            def readinto(self, into):
                data = self.raw.read(len(into))
                into[: len(data)] = data
                self.size += len(data)
                self.hash.update(data)
                return len(data)

        out = []
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = _store(path)
                with store.open_input_stream(at) as f:
                    raw = Counted(f)
                    reader = csv.reader(io.TextIOWrapper(io.BufferedReader(raw, 1 << 20), encoding, newline=""))
                    header = next(reader, [])
                    rows, missing, low, high = 0, [0] * len(header), [None] * len(header), [None] * len(header)
                    for r in reader:
                        if not r:
                            continue
                        rows += 1
                        for i, v in enumerate(r[: len(header)]):
                            if v == "":
                                missing[i] += 1
                            else:
                                low[i] = v if low[i] is None or v < low[i] else low[i]
                                high[i] = v if high[i] is None or v > high[i] else high[i]
                        for i in range(len(r), len(header)):
                            missing[i] += 1
                name = path.rsplit("/", 1)[-1]
                cells = list(zip(range(len(header)), header, missing, low, high, strict=True)) or [(None,) * 5]
                out += [(name, raw.size, raw.hash.hexdigest(), rows, *x) for x in cells]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = ["file", "bytes", "sha256", "rows", "place", "column", "missing", "low", "high"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 9, types, strict=True)], names)

    paths = list_files(spark, folder, suffix)
    paths = [p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p for p in paths]
    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))  # a task a file
    return files.mapInArrow(run, "file string, bytes long, sha256 string, rows long, place int, column string, missing long, low string, high string")


def fitted_block(spark: SparkSession, path: str, schema: str, where: str, order: list[str], keys: list[str], most_bytes: int = 8 << 20) -> DataFrame:
    """Rows of a typed CSV that a condition keeps, in order; repeated keys are an error, and so is more text than ``most_bytes``."""
    t = spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path).where(where)
    require_empty(repeated(t, keys, "repeated"), "repeated keys")
    size = t.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(x).cast("string")), F.lit(0)) + 1 for x in t.columns), F.lit(0)))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the block has {size} bytes of text")
    return t.orderBy(*order)


def write_official(games: DataFrame, folder: str, stem: str) -> None:
    """One folder of CSV a population and stem, named as the official file is; rows need Gender and the stem's columns."""
    cols = [c.split()[0] for c in SCHEMAS[stem].split(", ")]
    for g in "MW":
        games.where(F.col("Gender") == g).select(*cols).write.mode("errorifexists").option("header", True).csv(f"{folder}/{g}{stem}.csv")


def official_results(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """Both populations' rows of a stem, with declared types; malformed rows fail the read."""
    out = None
    for g in "MW":
        t = spark.read.option("header", True).option("mode", "FAILFAST").schema(SCHEMAS[stem]).csv(f"{folder}/{g}{stem}.csv").withColumn("Gender", F.lit(g))
        out = t if out is None else out.unionByName(t)
    return out
