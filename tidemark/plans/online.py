"""Incremental queries: a table is read in random mini-batches, and every batch refines the answer.

Each group keeps mergeable partial sums. After a batch the result is the query's answer on all rows so far, sums and
counts scaled up to the whole table; after the last batch it is exact. With trials, partial sums are kept for
bootstrap samples too, which gives each estimate an interval.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tables, written
from .batching import batch_sql, seed_sql


@dataclass(frozen=True)
class OnlineConf:
    batches: int = 6
    trials: int = 0
    confidence: float = 0.95
    slack: float = 2.0


@dataclass(frozen=True)
class Measure:
    """kind: sum, count, avg, min or max of value, an SQL expression over the query's rows; sums are of decimals."""

    name: str
    kind: str
    value: str = "1"

    def partials(self) -> dict[str, tuple[str, str]]:
        """Partial columns: (expression for a row, how partials merge)."""
        number = f"CAST({self.value} AS DECIMAL(24,6))"
        if self.kind == "sum":
            return {f"{self.name}_s": (number, "sum")}
        if self.kind == "count":
            return {f"{self.name}_n": (f"CASE WHEN ({self.value}) IS NOT NULL THEN 1 ELSE 0 END", "sum")}
        if self.kind == "avg":
            return {f"{self.name}_s": (number, "sum"), f"{self.name}_n": (f"CASE WHEN ({self.value}) IS NOT NULL THEN 1 ELSE 0 END", "sum")}
        return {f"{self.name}_m": (f"({self.value})", self.kind)}

    def answer(self, scale: str) -> str:
        n = self.name
        if self.kind == "sum":
            return f"CAST({n}_s AS DOUBLE) * {scale} AS {n}"
        if self.kind == "count":
            return f"CAST({n}_n AS DOUBLE) * {scale} AS {n}"
        if self.kind == "avg":
            return f"CAST({n}_s AS DOUBLE) / CAST(NULLIF({n}_n, 0) AS DOUBLE) AS {n}"
        return f"{n}_m AS {n}"


@dataclass(frozen=True)
class Query:
    """rows: SQL over {tables}, a row for each that counts, with keys and what measures need. result: SQL over {groups}."""

    stream: str
    rows: str
    keys: tuple[str, ...]
    measures: tuple[Measure, ...]
    result: str = "SELECT * FROM {groups}"
    statics: tuple[str, ...] = ()

    def partial_columns(self) -> dict[str, tuple[str, str]]:
        return {k: v for m in self.measures for k, v in m.partials().items()}

    def oracle(self, upto: int, batches: int) -> str:
        """The same answer as one SQL statement: the query on the first batches, scaled."""
        batch = batch_sql(self.stream, batches, "//")
        part = f"(SELECT * FROM {self.stream} WHERE {batch} < {upto})"
        keys = "".join(f"{k}, " for k in self.keys)
        partial = ", ".join(f"{how}({value}) AS {c}" for c, (value, how) in self.partial_columns().items())
        rows = self.rows.format(**{self.stream: part}, **{t: t for t in self.statics})
        by = f" GROUP BY {', '.join(self.keys)}" if self.keys else ""
        scale = "1.0::DOUBLE" if upto == batches else f"((SELECT count(*) FROM {self.stream})::DOUBLE / (SELECT count(*) FROM {part} AS p)::DOUBLE)"
        groups = f"SELECT {keys}{', '.join(m.answer(scale) for m in self.measures)} FROM (SELECT {keys}{partial} FROM ({rows}) AS r{by}) AS g"
        return f"WITH grouped AS ({groups}) {self.result.format(groups='grouped')}"


#: Chances that a Poisson(1) number is below 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def weight(seed, trial):
    """How often a row is in a trial's sample: once in trial 0, Poisson(1) times in others, from row seed and trial alone."""
    u = F.pmod(F.xxhash64(seed, trial), F.lit(1 << 40)) / F.lit(float(1 << 40))
    out = F.lit(len(POISSON))
    for k in range(len(POISSON) - 1, -1, -1):
        out = F.when(u < POISSON[k], k).otherwise(out)
    return F.when(trial == 0, 1).otherwise(out)


class OnlineQuery:
    """Iterates over a query's batches: collect_next() or next() give the answer after one more batch."""

    def __init__(self, spark: SparkSession, sf_dir: str, query: Query, conf: OnlineConf = OnlineConf()):
        self.spark, self.query, self.conf = spark, query, conf
        self.source = tables(spark, sf_dir, query.stream)[query.stream].withColumn("__batch", F.expr(batch_sql(query.stream, conf.batches))).withColumn("__seed", F.expr(seed_sql(query.stream)))
        self.statics = tables(spark, sf_dir, *query.statics) if query.statics else {}
        self.done, self.state = 0, None
        self._sizes: dict[int, int] | None = None

    @property
    def sizes(self) -> dict[int, int]:
        if self._sizes is None:
            self._sizes = {r["__batch"]: r["count"] for r in self.source.groupBy("__batch").count().collect()}
        return self._sizes

    @property
    def has_next(self) -> bool:
        return self.done < self.conf.batches

    @property
    def progress(self) -> tuple[int, int]:
        return self.done, self.conf.batches

    def scale(self, upto: int) -> float:
        seen = 1.0 if upto == self.conf.batches else float(sum(n for b, n in self.sizes.items() if b < upto))
        return 1.0 if upto == self.conf.batches else (float(sum(self.sizes.values())) / seen if seen else 1.0)

    def partials(self, part: DataFrame) -> DataFrame:
        """Partial sums of the query's rows over part of the stream, per group and, with trials, per trial."""
        columns = self.query.partial_columns()
        stream = part if self.conf.trials else part.drop("__batch", "__seed")
        rows = self.spark.sql(self.query.rows, **{self.query.stream: stream}, **self.statics)
        keys = list(self.query.keys)
        if self.conf.trials:
            if "__seed" not in rows.columns:
                raise ValueError("with trials, the query's rows must carry __seed")
            rows = rows.withColumn("__trial", F.explode(F.sequence(F.lit(0), F.lit(self.conf.trials - 1)))).withColumn("__w", weight(F.col("__seed"), F.col("__trial"))).where("__w > 0")
            keys = [*keys, "__trial"]
            aggs = [F.expr(f"{how}(({v}) * __w)" if how == "sum" else f"{how}({v})").alias(c) for c, (v, how) in columns.items()]
        else:
            aggs = [F.expr(f"{how}({v})").alias(c) for c, (v, how) in columns.items()]
        return rows.groupBy(*keys).agg(*aggs)

    def merge(self, state: DataFrame, new: DataFrame) -> DataFrame:
        keys = [*self.query.keys, *(["__trial"] if self.conf.trials else [])]
        kinds = dict(state.dtypes)
        return state.unionByName(new).groupBy(*keys).agg(*[F.expr(f"{how}({c})").cast(kinds[c]).alias(c) for c, (_, how) in self.query.partial_columns().items()])

    def groups(self, state: DataFrame, upto: int) -> DataFrame:
        scale = f"CAST({self.scale(upto)!r} AS DOUBLE)"
        keys = [*self.query.keys, *(["__trial"] if self.conf.trials else [])]
        return state.selectExpr(*keys, *[m.answer(scale) for m in self.query.measures])

    def shown(self, groups: DataFrame) -> DataFrame:
        if self.conf.trials:
            groups = groups.where("__trial = 0").drop("__trial")
        return self.spark.sql(self.query.result, groups=groups)

    def advance(self, batches: int, last: bool = False) -> DataFrame:
        """The answer after so many more batches, read in one pass; those before are not read again, only their partial sums are.

        last: no batch will follow, so that the state need not be written.
        """
        if not self.has_next:
            raise StopIteration
        upto = min(self.done + batches, self.conf.batches)
        whole = self.done == 0 and upto == self.conf.batches
        new = self.partials(self.source if whole else self.source.where((F.col("__batch") >= self.done) & (F.col("__batch") < upto)))
        state = new if self.state is None else self.merge(self.state, new)
        self.state = state if last else written(state, f"state-{self.done}")
        self.done = upto
        return self.shown(self.groups(self.state, self.done))

    def next(self) -> DataFrame:
        """The answer after one more batch."""
        return self.advance(1)

    def collect_next(self) -> list:
        return self.next().collect()

    def __iter__(self) -> Iterator[DataFrame]:
        while self.has_next:
            yield self.next()

    def run(self, upto: int | None = None) -> DataFrame | None:
        """The answer after upto batches, or all. Nobody asks for answers in between, so that what is left is read in one pass."""
        left = min(upto or self.conf.batches, self.conf.batches) - self.done
        return self.advance(left, last=True) if left > 0 else None

    def baseline(self, upto: int) -> DataFrame:
        """The answer after upto batches, computed from their rows at once: what run(upto) must equal."""
        return self.shown(self.groups(self.partials(self.source.where(F.col("__batch") < upto)), upto))

    def estimates(self) -> DataFrame:
        """Per group and measure a struct of point, lower and upper, from the trials in which the group occurs.

        After the last batch all three are the exact value.
        """
        if not self.conf.trials or self.state is None:
            raise ValueError("estimates need trials and a batch")
        c, final = self.conf.confidence, self.done == self.conf.batches
        groups = self.groups(self.state, self.done)
        out = []
        for m in self.query.measures:
            pairs = F.array_sort(F.collect_list(F.when(F.col(m.name).isNotNull(), F.struct("__trial", m.name))))
            values = F.array_sort(F.collect_list(m.name))
            n = F.size(values)
            point = F.try_element_at(pairs, F.lit(1))[m.name]
            low = F.try_element_at(values, (F.floor(n * (1 - c) / 2) + 1).cast("int"))
            high = F.try_element_at(values, F.greatest(F.ceil(n * (1 + c) / 2), F.lit(1)).cast("int"))
            out.append(F.struct(point.alias("point"), (point if final else low).alias("lower"), (point if final else high).alias("upper")).alias(m.name))
        return groups.groupBy(*self.query.keys).agg(*out)

    def cleanup(self) -> None:
        self.state = None


@dataclass
class UncertainQuery:
    """sum(measure) of rows whose value compares with factor times their key's average, which every batch changes.

    A key's average so far has a range, its error times the slack to either side. Rows outside the range are decided:
    in goes to a sum, out goes away. Rows inside wait and are looked at again each batch. Should an average leave the
    range by which rows were decided, all rows so far are decided anew, so that the answer is always that of the rows
    so far with the average of now.

    rows: SQL over {tables} with columns k, v, x: key, compared value, measure. less: v < factor * average, else v >.
    """

    spark: SparkSession
    sf_dir: str
    stream: str
    rows: str
    factor: float
    less: bool = True
    statics: tuple[str, ...] = ()
    conf: OnlineConf = field(default_factory=OnlineConf)
    recomputed: int = 0

    def __post_init__(self):
        self.base = OnlineQuery(self.spark, self.sf_dir, Query(self.stream, self.rows, ("k",), (Measure("x", "sum", "x"),), statics=self.statics), self.conf)
        self.done, self.averages, self.ranges, self.kept, self.waiting = 0, None, None, None, None

    def of(self, condition) -> DataFrame:
        part = self.base.source.where(condition).drop("__batch", "__seed")
        return self.spark.sql(self.rows, **{self.stream: part}, **self.base.statics).select("k", F.col("v").cast("decimal(24,6)").alias("v"), F.col("x").cast("decimal(24,6)").alias("x"))

    def decided(self, rows: DataFrame, ranges: DataFrame) -> DataFrame:
        """rows with side: 1 in, -1 out, 0 not known; and their key's average now."""
        low, high = F.col("low") * self.factor, F.col("high") * self.factor
        side = F.when(F.col("v") < low, 1 if self.less else -1).when(F.col("v") > high, -1 if self.less else 1).otherwise(0)
        return rows.join(ranges, F.col("k").eqNullSafe(F.col("rk"))).withColumn("side", side)

    def next(self) -> float | None:
        """The scaled sum after one more batch; None if no row is in."""
        new = written(self.of(F.col("__batch") == self.done), "rows")
        sums = new.groupBy("k").agg(F.sum("v").alias("s"), F.sum((F.col("v").cast("double") * F.col("v").cast("double"))).alias("q"), F.count("v").alias("n"))
        if self.averages is not None:
            sums = self.averages.unionByName(sums).groupBy("k").agg(F.sum("s").cast("decimal(34,6)").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
        self.averages = written(sums, "averages")
        self.done += 1
        mean = F.col("s").cast("double") / F.col("n")
        error = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n")) * self.conf.slack
        last = self.done == self.conf.batches
        now = self.averages.where("n > 0").select(F.col("k").alias("rk"), mean.alias("mean"), (mean if last else mean - error).alias("low"), (mean if last else mean + error).alias("high"))
        if self.ranges is not None:
            was = self.ranges.select(F.col("rk").alias("wk"), F.col("low").alias("wl"), F.col("high").alias("wh"))
            joined = now.join(was, F.col("rk").eqNullSafe(F.col("wk")), "left")
            if joined.where("mean < wl OR mean > wh").isEmpty():
                # a range only narrows: what was decided by the wider one stays decided
                now = joined.select("rk", "mean", F.greatest("low", F.coalesce("wl", "low")).alias("low"), F.least("high", F.coalesce("wh", "high")).alias("high"))
                new = new.unionByName(self.waiting)
            else:
                self.recomputed += 1
                new, self.kept = self.of(F.col("__batch") < self.done), None
        self.ranges = written(now, "ranges")
        sided = written(self.decided(new, self.ranges).select("k", "v", "x", "side", "mean"), "decided")
        sure = sided.where("side = 1").agg(F.sum("x").alias("x")).first()["x"]
        if sure is not None:
            self.kept = (self.kept or 0) + sure
        self.waiting = sided.where("side = 0").select("k", "v", "x")
        bound = F.col("mean") * self.factor
        open_ = sided.where("side = 0").where(F.col("v") < bound if self.less else F.col("v") > bound).agg(F.sum("x").alias("x")).first()["x"]
        if self.kept is None and open_ is None:
            return None
        return float((self.kept or 0) + (open_ or 0)) * self.base.scale(self.done)

    def run(self, upto: int | None = None) -> float | None:
        out = None
        while self.done < (upto or self.conf.batches):
            out = self.next()
        return out
