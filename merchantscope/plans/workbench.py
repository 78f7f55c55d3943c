"""Shared stages of the driver queries over one settlement book."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantscope.operators import anatomy as an
from merchantscope.operators import features as ft
from merchantscope.operators import scoring as sc
from merchantscope.operators.lanes import data_window
from merchantscope.operators.ranking import PIECE, WHOLE
from merchantscope.plans.live import live_feature_table, score_live
from merchantscope.session import ensure_conf, run_folder, stage_table
from merchantscope.sources.buckets import write_bucketed
from merchantscope.sources.catalog import adopt_table
from merchantscope.sources.substrings import SubstringIndex, write_index
from merchantscope.sources.timeline import Timeline, read_timeline, write_timeline


class Workbench:
    """A settlement book and the tables every job builds on.

    ``book`` tells where the inputs are: it has a method for each of them (settlement,
    merchants, live_transactions, ...) and ``table`` for the tables it was made of.

    The joined fact, the feature table and the score table are each written once
    per session and then read by many queries, as in a scheduled batch run.
    """

    def __init__(self, spark: SparkSession, book):
        self.spark = ensure_conf(spark)
        self.fixture = book

    @functools.cached_property
    def tx(self) -> DataFrame:
        return stage_table(self.fixture.settlement(), "settlement", compression="zstd")

    @functools.cached_property
    def crowded(self) -> DataFrame | None:
        """Merchants whose rows are never brought together in one task."""
        return ft.crowded_merchants(self.tx)

    @functools.cached_property
    def timeline(self) -> Timeline:
        """The joined fact laid out by month and day."""
        path = f"{run_folder(self.spark)}/{uuid.uuid4().hex}/timeline"
        write_timeline(self.tx, path)
        return read_timeline(self.spark, path, self.tx.schema)

    @functools.cached_property
    def split_ceilings(self) -> DataFrame:
        """Ceilings that split groups stay below, per merchant; several drill-downs read them."""
        groups = stage_table(an.split_groups(self.tx), "split_groups")
        return stage_table(an.split_ceilings(an.split_group_amounts(self.tx, groups)), "split_ceilings")

    @functools.cached_property
    def explorer_tx(self) -> DataFrame:
        """The fact as the explorer reads it, bucketed by merchant and piece."""
        name = f"explorer_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        spread = ["merchant_id", "transaction_datetime_utc", "settlement_amount_usd", "card_token_id"]
        return write_bucketed(self.tx, name, f"{run_folder(self.spark)}/{name}", spread, buckets, self.crowded)

    @property
    def whole_pieces(self) -> Column:
        """Pieces of the explorer's fact that hold their merchant whole: all, where none is crowded."""
        return F.lit(True) if self.crowded is None else F.col(PIECE) == WHOLE

    @property
    def named_tx(self) -> DataFrame:
        """The explorer's transactions: the fact with merchant names, joined where a query reads them."""
        return self.tx.join(self.merchants.select("merchant_id", "merchant_name"), "merchant_id", "left")

    @functools.cached_property
    def merchants(self) -> DataFrame:
        return self.fixture.merchants()

    @functools.cached_property
    def catalog_tables(self) -> dict[str, str]:
        """Driver tables as catalog tables with statistics, over their files: name to catalog name."""
        made = {t: f"{t}_{uuid.uuid4().hex}" for t in ("region", "nation", "customer", "orders", "lineitem")}
        for name, stored in made.items():
            adopt_table(self.spark, stored, f"{self.fixture.folder}/{name}.parquet")
        return made

    def _index(self, df: DataFrame, key: str, cols: list[str]) -> SubstringIndex:
        path = f"{run_folder(self.spark)}/{uuid.uuid4().hex}/substrings"
        write_index(df, key, cols, path)
        return SubstringIndex(self.spark, path, df.schema[key].dataType)

    @functools.cached_property
    def merchant_index(self) -> SubstringIndex:
        return self._index(self.merchants, "merchant_id", ["merchant_id", "merchant_name"])

    @functools.cached_property
    def part_index(self) -> SubstringIndex:
        return self._index(self.fixture.table("part"), "p_partkey", ["p_name", "p_type"])

    @functools.cached_property
    def features(self) -> DataFrame:
        # The explorer's fact spares exchanges, but is not worth laying out for these alone.
        made = ft.merchant_features(
            self.tx, self.merchants, self.fixture.mcc_reference(), self.fixture.bands(), laid=vars(self).get("explorer_tx")
        )
        return stage_table(made, "merchant_features")

    @functools.cached_property
    def scored_z(self) -> DataFrame:
        """Scores with the z-scores kept."""
        return stage_table(sc.score_merchants(self.features, keep_z=True), "merchant_scores")

    @functools.cached_property
    def scores(self) -> DataFrame:
        return self.scored_z.drop(*[c for c in self.scored_z.columns if c.startswith("z_")])

    @functools.cached_property
    def live_tx(self) -> DataFrame:
        return self.fixture.live_transactions(self.tx)

    @functools.cached_property
    def live_window(self) -> tuple[Column, int]:
        return data_window(self.live_tx)

    @functools.cached_property
    def live_features(self) -> DataFrame:
        f = self.fixture
        made = live_feature_table(self.live_tx, f.live_merchants(), f.profiles(), f.known_bad())
        return stage_table(made, "live_features")

    @functools.cached_property
    def live_records(self) -> DataFrame:
        return stage_table(score_live(self.live_features, self.fixture.profiles()), "live_records")


def _rounded(x: Column, dp: int) -> Column:
    """Round half away from zero, in two steps, without a negative zero.

    The first step (three more places) removes the noise that the order of a
    floating-point sum leaves, so that an exact tie is always rounded the same way.
    """
    def once(v: Column, places: int) -> Column:
        scale = float(10**places)
        near = F.signum(v) * F.floor(F.abs(v) * scale + 0.5) / scale
        return F.when(F.abs(v) < 1e18 / scale, near).otherwise(v)

    return once(once(x, dp + 3), dp) + F.lit(0.0)


def tidy(df: DataFrame, dp: int = 6) -> DataFrame:
    """Result form: doubles rounded, dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = _rounded(c, dp)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)
