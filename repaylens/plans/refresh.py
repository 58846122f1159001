"""A stored account summary that follows new facts.

The summary is a Parquet table partitioned by a hash of the account. A refresh computes
anew only the accounts whose facts arrived, and rewrites only the partitions they fall
into; the files these held before are removed by that. Readers who listed the table before
a refresh must list it again.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repaylens.operators.accounts import ACCOUNT
from repaylens.plans.reporting import vw_customer_summary
from repaylens.schemas import TEST_WINDOW
from repaylens.session import remove_path
from repaylens.sources.files import Tables, stored_at

PART, PRESENT = "account_part", "account_present"


class StoredSummary:
    """``vw_customer_summary`` in ``folder``. Accounts without an id belong to one part."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 256, window: tuple[date, date] = TEST_WINDOW):
        self.spark, self.folder, self.parts, self.window = spark, folder.rstrip("/"), parts, window

    def build(self, t: Tables) -> None:
        """Compute all accounts and replace whatever is stored."""
        remove_path(self.spark, self.folder)
        rows = self._marked(vw_customer_summary(t, self.window))
        rows.repartition(PART).write.partitionBy(PART).parquet(self.folder)

    def read(self) -> DataFrame:
        return self._stored().filter(PRESENT).drop(PART, PRESENT)

    def refresh(self, t: Tables, arrived: Mapping[str, DataFrame]) -> None:
        """Bring the accounts of ``arrived`` up to date with ``t``, which holds all facts.

        ``arrived`` has new, changed or withdrawn rows of some source tables; the accounts
        they name, and those of the clients they name, are computed anew. An account that
        ``t`` no longer holds goes.
        """
        changed, changed_path = stored_at(self._accounts_of(t, arrived))
        parts = [row[0] for row in changed.select(self._part()).distinct().collect()]  # self.parts at most
        if not parts:
            remove_path(self.spark, changed_path)
            return
        own = {name: df.join(changed, ACCOUNT, "left_semi") if ACCOUNT in df.columns else df for name, df in t.items()}
        kept = self._stored().filter(F.col(PART).isin(parts) & F.col(PRESENT)).join(changed, ACCOUNT, "left_anti")
        fresh = self._marked(vw_customer_summary(own, self.window))
        # a row that stands for the part itself, so that a part without accounts is rewritten too
        marks = self.spark.createDataFrame([(int(p), False) for p in parts], f"{PART} int, {PRESENT} boolean")
        rows, path = stored_at(kept.unionByName(fresh).unionByName(marks, allowMissingColumns=True))
        writer = rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(PART).parquet(self.folder)
        remove_path(self.spark, path)
        remove_path(self.spark, changed_path)

    def remove(self) -> None:
        remove_path(self.spark, self.folder)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.folder)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(ACCOUNT), F.lit(self.parts)).cast("int").alias(PART)

    def _marked(self, summary: DataFrame) -> DataFrame:
        return summary.select("*", self._part(), F.lit(True).alias(PRESENT))

    @staticmethod
    def _accounts_of(t: Tables, arrived: Mapping[str, DataFrame]) -> DataFrame:
        found = t["customers"].select(ACCOUNT).limit(0)
        for name, rows in arrived.items():
            if name == "clients":
                rows = t["customers"].join(rows.select("client_id").distinct(), "client_id", "left_semi")
            found = found.unionByName(rows.select(ACCOUNT))
        return found.filter(F.col(ACCOUNT).isNotNull()).distinct()
