"""Generation of questions in rounds, for all windows of all jobs at a time.

Windows (job, window_no, notes, wanted) ask for a little more than is wanted, in chunks; their replies are sifted. Windows that are still short ask again, at most PER_WINDOW
times, and are told what not to repeat; then the windows of a job are merged, near duplicates between them dropped, and jobs that are still short ask
at most OVERALL times more, from their windows in turn. Each round is one plan over all that is short: new questions are held against a checkpointed table of those kept
and then against each other. A round that gives nothing counts; what is over the wanted number is left out at the end of a window and of a job.

``ask`` turns prompts (job, window_no, chunk_no, prompt) into replies (job, window_no, chunk_no, reply), as ``adapters.replies`` does. Kept questions sort by window, round, chunk and position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators import dedup as D
from lectern.operators.relational import same
from lectern.plans import generation as G
from lectern.plans import prompts
from lectern.sources.tables import shared

Ask = Callable[[DataFrame], DataFrame]
PER_WINDOW, OVERALL = 5, 12
#: A first request beyond CHUNK + 2 questions is cut into chunks of CHUNK; OVERASK is the share asked for at first, MOST the most asked for later.
CHUNK, OVERASK, MOST = 15, 1.2, 25
#: Kept questions that a later prompt names as not to be repeated, and the number of question formats.
AVOID, FORMATS = 60, 14


def first_sizes(wanted: Column) -> Column:
    """Sizes of the chunks that a window asks for at first."""
    n = F.greatest(wanted, F.round(wanted * OVERASK).cast("int"))
    full = F.array_repeat(F.lit(CHUNK), F.floor(n / CHUNK).cast("int"))
    cut = F.concat(full, F.when(n % CHUNK > 0, F.array((n % CHUNK).cast("int"))).otherwise(F.array().cast("array<int>")))
    return F.when(n > CHUNK + 2, cut).otherwise(F.array(n.cast("int")))


def more(short: Column) -> Column:
    """How many to ask for when so many are missing."""
    return F.least(F.lit(MOST), F.greatest(short, F.round(short * 2).cast("int")))


def formats(before: Column, n: Column) -> Column:
    """Format numbers of ``n`` questions that follow ``before`` others, all formats in turn."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (before + i) % FORMATS + 1)


def _first(windows: DataFrame, ask_for: Callable[..., Column]) -> DataFrame:
    own = windows.filter("wanted > 0").withColumn("_sizes", first_sizes(F.col("wanted")))
    rows = own.select("job", "window_no", "notes", F.size("_sizes").alias("_of"), F.posexplode("_sizes").alias("chunk_no", "n"))
    hint = F.when(F.col("_of") > 1, prompts.part_of(F.col("chunk_no") + 1, F.col("_of")))
    return rows.select("job", "window_no", "chunk_no", F.concat_ws("\n", ask_for(F.col("notes"), F.col("n"), formats(F.col("chunk_no") * CHUNK, F.col("n")), None), hint).alias("prompt"))


def _again(short: DataFrame, kept: DataFrame, by: list[str], ask_for: Callable[..., Column]) -> DataFrame:
    """Prompts of those still short (by, window_no, notes, have, missing), which name the last kept questions."""
    w = Window.partitionBy(*by).orderBy(F.col("place").desc())
    last = kept.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= AVOID)
    last = last.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "question"))), lambda x: x["question"]).alias("_avoid"))
    both = short.join(last.withColumnsRenamed({c: f"_k_{c}" for c in by}), same(by, "_k_"), "left")
    n = more(F.col("missing"))
    avoid = F.coalesce("_avoid", F.array().cast("array<string>"))
    return both.select("job", "window_no", F.lit(0).alias("chunk_no"), ask_for(F.col("notes"), n, formats(F.col("have"), n), avoid).alias("prompt"))


def _questions(prompted: DataFrame, ask: Ask, language: str, scope: tuple[str, ...], place: Column, kept: DataFrame | None) -> DataFrame:
    """What a round adds: the ok questions of its replies, checkpointed (replies come from outside and are asked for once)."""
    rows = G.questions_of(ask(prompted).checkpoint()).withColumn("place", place).checkpoint()
    if rows.isEmpty():
        return rows.drop("position").withColumns({c: F.lit("") for c in ("key", "answer_text")})
    return G.sifted(rows, language, scope, kept).filter("status = 'ok'").drop("status").checkpoint()


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("have")).withColumnsRenamed({c: f"_n_{c}" for c in by})


def _upto(rows: DataFrame, by: list[str], wanted: DataFrame) -> DataFrame:
    """The first ``wanted`` rows of each group."""
    w = Window.partitionBy(*by).orderBy("place")
    held = wanted.select(*(F.col(c).alias(f"_w_{c}") for c in by), F.col("wanted").alias("_most"))
    return rows.withColumn("_nth", F.row_number().over(w)).join(held, same(by, "_w_")).filter("_nth <= _most").drop("_nth", "_most", *(f"_w_{c}" for c in by))


def filled(windows: DataFrame, ask: Ask, ask_for: Callable[..., Column], language: str, per_window: int = PER_WINDOW, overall: int = OVERALL) -> DataFrame:
    """At most the wanted number of questions of each job (the sum over its windows), in order of ``place``.

    ``ask_for(notes, n, formats, avoid)`` builds a prompt. Windows without notes or that want nothing ask nothing.
    """
    shared(windows.sparkSession)
    windows = windows.filter("notes IS NOT NULL").checkpoint()
    by = ["job", "window_no"]
    placed = lambda n: F.format_string("0.%06d.%04d.%06d.%06d", "window_no", F.lit(n), "chunk_no", "position")
    kept = _questions(_first(windows, ask_for), ask, language, tuple(by), placed(0), None)
    for n in range(1, per_window + 1):
        counted = windows.filter("wanted > 0").join(_counted(kept, by), same(by, "_n_"), "left").withColumn("have", F.coalesce("have", F.lit(0)))
        short = counted.filter("have < wanted").select(*by, "notes", "have", (F.col("wanted") - F.col("have")).alias("missing"))
        if short.isEmpty():
            break
        kept = kept.unionByName(_questions(_again(short, kept, by, ask_for), ask, language, tuple(by), placed(n), kept))
    jobs = windows.groupBy("job").agg(F.sum("wanted").cast("int").alias("wanted"), F.sort_array(F.collect_set("window_no")).alias("_windows"))
    merged = _upto(kept, by, windows)
    fresh = D.greedy(merged, ["job"], "place", "key", "answer_text", with_answer=D.WITH_ANSWER).filter("status = 'kept'")
    kept = merged.join(fresh.select(F.col("job").alias("_f_job"), F.col("place").alias("_f_place")), same(["job", "place"], "_f_"), "left_semi").checkpoint()
    for n in range(overall):
        counted = jobs.join(_counted(kept, ["job"]), same(["job"], "_n_"), "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < wanted")
        turn = counted.select(F.col("job").alias("_t_job"), "have", (F.col("wanted") - F.col("have")).alias("missing"), F.element_at("_windows", F.lit(n) % F.size("_windows") + 1).alias("_t_window_no"))
        short = windows.join(turn, same(by, "_t_")).select(*by, "notes", "have", "missing")
        if short.isEmpty():
            break
        late = F.format_string("1.%06d.%04d.%06d.%06d", F.lit(n), F.lit(0), "chunk_no", "position")
        kept = kept.unionByName(_questions(_again(short, kept, ["job"], ask_for), ask, language, ("job",), late, kept))
    return _upto(kept, ["job"], jobs)
