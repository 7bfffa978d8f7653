"""Newly arriving linkage tasks as a stream of pair files: search a model, apply it, append the predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators.distribution import histogram, task_name
from linkspark.plans import reuse

PAIRS = "src_a string, src_b string, id_a string, id_b string, features array<double>"
STATE = "batch long, ready array<string>, held array<string>, members map<string, array<string>>"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the pair files that land in a folder."""
    return spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


class Arrivals:
    """State of the stream: the integrated sources, the folders of tasks that wait for a source, the members of each model.

    Waiting tasks are tried again in every batch, so a task is classified as
    soon as one of its sources is integrated, whatever the order of arrival.
    A batch starts from the state that the one before it wrote below
    ``waiting`` and writes its own once its predictions are in
    ``out/batch=<number>``. A stream that is started anew on the same folders
    and checkpoint, with the same models, goes on with what it held, and a
    repeated batch replaces its own output. Models do not change here.
    """

    def __init__(self, registry: reuse.Registry, ready: set[str], out: str, waiting: str, cfg: reuse.ReuseConfig) -> None:
        self.registry, self.ready, self.out, self.waiting, self.cfg = registry, set(ready), out, waiting, cfg
        self.held: list[str] = []
        self.last: int | None = None
        self.initial = (set(ready), {k: list(v) for k, v in registry.members.items()})

    def _resume(self, spark: SparkSession, number: int) -> None:
        """Take up the newest state from before this batch, else the initial one."""
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.waiting}/state")
        known = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
        states = spark.read.schema(STATE).option("recursiveFileLookup", True).json(folder.toString()) if known else spark.createDataFrame([], STATE)
        found = states.where(F.col("batch") < number).orderBy(F.desc("batch")).first()
        ready, members = (found["ready"], found["members"]) if found else self.initial
        self.ready, self.held = set(ready), list(found["held"]) if found else []
        self.registry.members.clear()
        self.registry.members.update({k: list(v) for k, v in members.items()})

    def batch(self, rows: DataFrame, number: int) -> None:
        """Classify what can be classified, all tasks in one query; hold back the rest."""
        spark = rows.sparkSession
        if self.last is None or self.last >= number:
            self._resume(spark, number)
        landed = f"{self.waiting}/batch={number}"
        rows.write.mode("overwrite").parquet(landed)
        self.held = [p for p in self.held if p != landed] + [landed]
        pairs = spark.read.schema(PAIRS).parquet(*self.held)
        tasks = [(r["task"], r["src_a"], r["src_b"]) for r in pairs.select(task_name().alias("task"), "src_a", "src_b").distinct().orderBy("task").collect()]  # a row per task
        fits = reuse.best_models(histogram(pairs), [t[0] for t in tasks], self.registry, self.cfg)
        open_tasks, done, moved = [t for t in tasks if t[0] in fits], [], True
        while moved:
            reached = [t for t in open_tasks if t[1] in self.ready or t[2] in self.ready]
            done += reached
            open_tasks = [t for t in open_tasks if t not in reached]
            self.ready |= {s for t in reached for s in t[1:]}
            moved = bool(reached)
        if done:
            leaders = {t[0]: fits[t[0]] for t in done}
            reuse.predict_all(pairs, leaders, self.registry).withColumn("task", task_name()).write.mode("overwrite").parquet(f"{self.out}/batch={number}")
            for task, leader in leaders.items():
                if task not in self.registry.members[leader]:
                    self.registry.members[leader].append(task)
            rest = f"{self.waiting}/rest={number}"
            pairs.join(F.broadcast(spark.createDataFrame([t[1:] for t in done], "src_a string, src_b string")), ["src_a", "src_b"], "left_anti").write.mode("overwrite").parquet(rest)
            self.held = [rest]
        state = [(number, sorted(self.ready), self.held, self.registry.members)]
        spark.createDataFrame(state, STATE).coalesce(1).write.mode("overwrite").json(f"{self.waiting}/state/at={number}")
        self.last = number


def start(stream: DataFrame, state: Arrivals, checkpoint: str):
    """Run the stream over what is there; the caller waits for the query."""
    return stream.writeStream.foreachBatch(state.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
