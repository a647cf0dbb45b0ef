"""Size-tiered compaction of tiny text files into few well-sized ones, each record version once.

A store is a folder of runs and a journal. Taking in tiny files makes runs of level 1 in one narrow pass. Runs of similar
size are merged, level by level: a merge finds the earliest file of each version by digests alone, keeps its text, and
records the ids of the others. A transaction is committed by one rename in the journal, so a job that is stopped anywhere
is simply run again: what is committed is skipped, what is not is made anew, and a reader only ever sees committed runs
that no later commit has replaced. Replaced runs stay until `grace` seconds have gone by, for readers that planned on them.

Two files are one version if record and text are equal, all line ends counted as one character; the earliest by time
of writing (then by id) stays. Files with a null text or a null record can't be compared and are all kept, as is an
empty text's first file. Ids tell files apart. Columns beside those named stay as they are.
"""

from __future__ import annotations

import hashlib
import math
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelode.session import cores
from notelode.sources.files import universal_newlines
from notelode.sources.shared import Folder

_DIGEST, _KEPT, _SIZE, _RUN = "_store_digest", "_store_kept", "_store_size", "_store_run"


@dataclass
class Store:
    spark: SparkSession
    path: str
    target_bytes: int = 128 << 20
    fan_in: int = 4
    #: Seconds for which a replaced run can still be read.
    grace: float = 24 * 3600
    id: str = "file_id"
    record: str = "record_id"
    text: str = "text"
    written: str = "written_at"
    folder: Folder = field(init=False)
    _known: dict[str, dict] = field(init=False, default_factory=dict)

    def __post_init__(self) -> None:
        self.folder = Folder(self.spark, self.path)

    # The journal.

    def commits(self) -> list[dict]:
        """Committed transactions in order; each entry is read once, as entries never change."""
        for n in self.folder.names("journal"):
            if n.endswith(".commit.json") and n not in self._known:
                self._known[n] = self.folder.get(f"journal/{n}")
        return sorted(self._known.values(), key=lambda x: (x["at"], x["tx"]))

    def _is_done(self, tx: str) -> bool:
        return f"{tx}.commit.json" in self._known or any(x["tx"] == tx for x in self.commits())

    def live(self) -> list[dict]:
        """Committed runs that no later commit took in."""
        done = self.commits()
        used = {r for x in done for r in x["inputs"]}
        return [r for x in done for r in x["runs"] if r["run"] not in used]

    def _commit(self, tx: str, level: int, inputs: list[str], rows: DataFrame) -> None:
        """Write rows as runs, by their number if they have one, and commit all of them at once."""
        self.folder.put(f"journal/{tx}.intent.json", {"tx": tx, "level": level, "inputs": inputs})
        self.folder.delete(f"runs/{tx}")  # left by an attempt that didn't commit
        many = _RUN in rows.columns
        rows.write.partitionBy(*([_RUN] if many else []), _KEPT).parquet(f"{self.path}/runs/{tx}")
        names = [f"{tx}/{n}" for n in self.folder.names(f"runs/{tx}") if n.startswith(_RUN)] if many else [tx]
        runs = []
        for name in names:
            kept = self.folder.sizes(f"runs/{name}/{_KEPT}=true") if self.folder.exists(f"runs/{name}/{_KEPT}=true") else []
            runs.append({"run": name, "level": level, "files": len(kept), "bytes": sum(kept)})
        self.folder.put(f"journal/{tx}.commit.json", {"tx": tx, "level": level, "inputs": inputs, "runs": runs, "at": time.time()})

    def vacuum(self) -> None:
        """Delete the texts of runs that were replaced longer than grace ago; what they dropped stays on record."""
        for x in self.commits():
            if time.time() - x["at"] >= self.grace:
                for old in x["inputs"]:
                    self.folder.delete(f"runs/{old}/{_KEPT}=true")

    # Reading.

    def _rows(self, runs: list[dict], kept: bool) -> DataFrame | None:
        paths = [f"{self.path}/runs/{x['run']}/{_KEPT}={str(kept).lower()}" for x in runs]
        paths = [p for p in paths if self.folder.exists(p[len(self.path) + 1 :])]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The files of the store, every record version once; None for an empty store."""
        rows = self._rows(self.live(), True)
        return rows.drop(_DIGEST, _SIZE) if rows is not None else None

    def dropped(self) -> DataFrame:
        """Ids of the files that were stored already, over all transactions."""
        rows = self._rows([r for x in self.commits() for r in x["runs"]], False)
        return rows.select(self.id) if rows is not None else self.spark.createDataFrame([], f"{self.id} bigint")

    # Merging.

    def _marked(self, rows: DataFrame, parts: int) -> DataFrame:
        """Mark the earliest file of each version; the others keep their id alone.

        Which one it is is found from digests, summed up before they are shuffled, so a version that makes up a third of
        all files is one row from each task. Texts move once, by id, which spreads them evenly whatever is in them.
        """
        first = rows.groupBy(self.record, _DIGEST).agg(F.min(F.struct(self.written, self.id)).alias("first"))
        first = first.select(F.col("first")[self.id].alias("_store_first"))
        dealt = rows.repartition(parts, self.id).join(first.repartition(parts, "_store_first"), F.col(self.id) == F.col("_store_first"), "left")
        marked = dealt.withColumn(_KEPT, F.col("_store_first").isNotNull()).drop("_store_first")
        keep = lambda c: c if c == self.id else F.when(F.col(_KEPT), F.col(c)).alias(c)
        return marked.select(*(keep(c) for c in rows.columns), _KEPT)

    def ingest(self, files: DataFrame, batch: str, runs: int = 1) -> None:
        """Take in a batch of tiny files as runs of level 1, without a shuffle. A batch that is in is not taken again."""
        tx = hashlib.sha256(f"batch {batch}".encode()).hexdigest()[:24]
        if self._is_done(tx):
            return
        plain = universal_newlines(F.col(self.text))
        comparable = F.col(self.text).isNotNull() & F.col(self.record).isNotNull()
        rows = files.withColumns(
            {
                _DIGEST: F.when(comparable, F.unhex(F.sha2(plain, 256))).otherwise(F.encode(F.concat(F.lit("id "), F.col(self.id).cast("string")), "UTF-8")),
                _SIZE: F.coalesce(F.octet_length(self.text), F.lit(0)),
                _RUN: F.pmod(F.xxhash64(self.id), F.lit(runs)).cast("int"),
                _KEPT: F.lit(True),
            }
        )
        # A scan of many tiny files has many tasks; each writes a file for every run, so there are no more than fill the slots.
        self._commit(tx, 1, [], rows.coalesce(cores(self.spark)) if runs > 1 else rows)

    def tiers(self) -> dict[int, list[dict]]:
        """Live runs by size class: a class spans a factor of fan_in."""
        out: dict[int, list[dict]] = {}
        for x in self.live():
            out.setdefault(round(math.log(max(x["bytes"], 1), self.fan_in)), []).append(x)
        return out

    def merge(self, runs: list[dict]) -> None:
        """Merge runs into one of the next level, in files of about target_bytes."""
        inputs = sorted(x["run"] for x in runs)
        tx = hashlib.sha256(f"merge {inputs}".encode()).hexdigest()[:24]
        rows = self._rows(runs, True)
        if rows is None or self._is_done(tx):
            return
        parts = max(1, math.ceil(sum(x["bytes"] for x in runs) / self.target_bytes))
        self._commit(tx, 1 + max(x["level"] for x in runs), inputs, self._marked(rows, parts))

    def settle(self) -> None:
        """Merge each size class that holds fan_in runs, fan_in at a time, as long as there is one."""
        while ready := [runs for runs in self.tiers().values() if len(runs) >= self.fan_in]:
            for runs in ready:
                runs = sorted(runs, key=lambda x: (x["bytes"], x["run"]))
                for i in range(0, len(runs) - self.fan_in + 1, self.fan_in):
                    self.merge(runs[i : i + self.fan_in])

    def finish(self) -> None:
        """Merge all runs into one, so that every version has met every other; for a store at rest."""
        live = self.live()
        if len(live) > 1 or any(x["level"] == 1 for x in live):
            self.merge(live)


def compact(files: DataFrame, path: str, **options) -> Store:
    """Consolidate a table of tiny files into a store at path; run again after a failure, it goes on where it was.

    Files come in as fan_in ** 2 runs of level 1, which two levels of merges make one.
    """
    store = Store(files.sparkSession, path, **options)
    store.ingest(files, "all", store.fan_in**2)
    store.settle()
    store.finish()
    store.vacuum()
    return store
