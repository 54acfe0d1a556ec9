"""Changes of tables as new DataFrames: the caller writes the result to a new path and never to one that is being read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.relational import in_keys, not_in
from lectern.sources.tables import shared


def append_with_ids(stored: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``new`` with ids that follow the largest stored one."""
    return numbered(new, key, order, stored.agg(F.coalesce(F.max(key), F.lit(0)).alias("last")).scalar())


def numbered(new: DataFrame, key: str, order: list[Column], last: Column) -> DataFrame:
    """Numbers after ``last`` in an order of all rows; distributed: offsets by partition, no single sorted task. The sorted rows are checkpointed, as they are read twice."""
    shared(new.sparkSession)
    spread = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id()).checkpoint()
    size = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_nth").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = size.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("_part", "_before", "_low")  # one row a partition
    numbered = spread.join(F.broadcast(starts), "_part")
    return numbered.withColumn(key, last + F.col("_before") + F.col("_nth") - F.col("_low") + 1).drop("_part", "_nth", "_before", "_low")


def by_number_in_text(df: DataFrame, name: str, text: str, position: str) -> DataFrame:
    """The place of each row by the whole number in a text of digits (0 for any other), rows of one number in the order of ``position``."""
    core = T.strip(F.coalesce(text, F.lit("")))
    number = F.coalesce(F.when(core.rlike("^[0-9]+$"), core.try_cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return numbered(df.withColumn("_number", number), name, [F.col("_number"), F.col(position)], F.lit(0)).drop("_number")


def replace_partition(stored: DataFrame, new: DataFrame, column: str, value) -> DataFrame:
    """All rows of one partition value replaced by ``new``."""
    return stored.filter(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new)


def overwrite_partitions(new: DataFrame, path: str, column: str) -> None:
    """Writes ``new`` into a Parquet table partitioned by ``column``: partitions that it has rows of are replaced, the files of all others stay as they are.

    A value whose partition is to become empty has no rows here; ``emptied`` removes it.
    """
    new.write.partitionBy(column).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def emptied(spark: SparkSession, path: str, column: str, value: str) -> None:
    """Removes the partition of one value of a table on any store that Spark can write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def selection_of(bank: DataFrame, wanted: DataFrame, batch: Column) -> DataFrame:
    """Question ids that are wanted, exist and belong to the batch, each once."""
    return in_keys(bank.filter(batch), "id", wanted).select(F.col("id").alias("question_id")).distinct()


def delete_keys(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return not_in(df, gone, key, gone.columns[0])


def cascade_delete(parent: DataFrame, child: DataFrame, gone: DataFrame, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parent and child without the keys that are gone."""
    return delete_keys(parent, key, gone), delete_keys(child, child_key, gone)


def point_update(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """New values in the rows that match; the others as they are."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


LETTERS = ("A", "B", "C", "D")


def edit_errors(question: Column, answer: Column, options: Column) -> Column:
    """What is wrong with an edit, the first of: no question, no answer letter, not all four options; null if nothing."""
    empty = lambda c: T.strip(F.coalesce(c, F.lit(""))) == ""
    unfilled = F.exists(F.array(*map(F.lit, LETTERS)), lambda x: empty(F.try_element_at(options, x)))
    letter = F.upper(T.strip(F.coalesce(answer, F.lit(""))))
    return F.when(empty(question), "question").when(~letter.isin(*LETTERS), "answer").when(unfilled, "options")


def edited(bank: DataFrame, edits: DataFrame, key: str, now: Column) -> DataFrame:
    """The bank with valid edits (key, question, options, answer, explanation) trimmed and put in, letters as numbers and ``updated_at`` set.

    Edits that are wrong by ``edit_errors`` and those of unknown keys change nothing; of several edits of a key the one that sorts last
    by question, answer, explanation and options counts.
    """
    c = F.col
    order = F.struct("question", "answer", "explanation", F.to_json("options"))
    good = edits.filter(edit_errors(c("question"), c("answer"), c("options")).isNull()).groupBy(key).agg(F.max_by(F.struct("question", "answer", "explanation", "options"), order).alias("_e")).select(key, "_e.*")
    text = lambda x: T.strip(F.coalesce(x, F.lit("")))
    fields = {"dy_question": text(c("question")), **{f"dy_ans_{n}": text(F.try_element_at("options", F.lit(x))) for n, x in enumerate(LETTERS, 1)}}
    fields |= {"dy_correct_ans": (F.ascii(F.upper(text(c("answer")))) - 64).cast("string"), "dy_explain": text(c("explanation")), "updated_at": now}
    new = good.select(c(key), F.lit(True).alias("_edit"), *(v.alias(f"_new_{k}") for k, v in fields.items()))
    both = bank.join(new, key, "left")
    return both.withColumns({k: F.when(c("_edit"), c(f"_new_{k}")).otherwise(c(k)) for k in fields}).select(bank.columns)


def tag(df: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Non-null new values overwrite, '' too; null ones keep the old. Of several changes of a key the one that sorts last counts."""
    new = changes.groupBy(key).agg(F.max(F.struct(*(F.col(c).alias(f"_new_{c}") for c in columns))).alias("_n")).select(key, "_n.*")
    joined = df.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*(f"_new_{c}" for c in columns))


def insert_if_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return stored.unionByName(not_in(new.dropDuplicates([key]), stored, key, key))


def untag(df: DataFrame, gone: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Nulls in the columns of the rows whose key is listed."""
    keys = gone.select(F.col(gone.columns[0]).alias("_key")).distinct()
    hit = F.col("_key").isNotNull()
    joined = df.join(keys, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.when(~hit, F.col(c)) for c in columns}).drop("_key")


def last_of(changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last change of each key."""
    w = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order))
    return changes.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Matched keys take the change's values, other changes are added; ``changes`` has each key once."""
    values = [c for c in stored.columns if c not in keys]
    new = changes.select(*keys, F.lit(True).alias("_new"), *(F.col(c).alias(f"_new_{c}") for c in values))
    both = stored.join(new, keys, "full_outer")
    return both.select(*keys, *(F.when(F.col("_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in values)).select(stored.columns)


def migrated(df: DataFrame, columns: dict[str, str], renames: dict[str, str]) -> DataFrame:
    """Additive migration: renames where the old name exists and the new does not, then missing columns as typed nulls."""
    for old, new in renames.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def backfilled(df: DataFrame, target: str, source: str) -> DataFrame:
    """Letters A-D of ``source`` as 1-4 where the target is null or empty."""
    letter = F.upper(F.trim(F.col(source)))
    number = F.when(letter.isin("A", "B", "C", "D"), (F.ascii(letter) - 64).cast("string"))
    return df.withColumn(target, F.when(F.coalesce(F.col(target), F.lit("")) == "", F.coalesce(number, F.col(target))).otherwise(F.col(target)))
