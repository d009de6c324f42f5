"""Reconstruction errors, thresholds, training loop data and the model registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from checks.catalog import query, r6, s6
from checks.sequences import KEYS, sequences
from netweave.functions import losses
from netweave.operators import registry as rg
from netweave.operators import scoring as sc
from netweave.schemas import FEATURES
from netweave.session import settled
from netweave.sources.tables import model_registry, predictions, table, training_metrics


def settled_sequences(spark, folder):
    """Fitting and scoring read the sequences; they are built once."""
    rows = sequences(spark, folder)
    kept = rows.select("_id", *KEYS, "ts", "is_training", "sequence", "familiarity")
    return settled(kept, "sequences")


def scored(spark, folder):
    rows = settled_sequences(spark, folder)
    return sc.score_by_mean(rows, sc.mean_model(rows.filter("is_training")))


FLAGGED = f"""select sensor_id, epoch, seq_no, is_training, {s6('reconstruction_error')} as reconstruction_error,
  reconstruction_error >= 0.5e0 as is_anomaly from scored"""


@query("flagged_sequences", "D9, D10, D11, B9, C1-C7", v.sql(v.SCORED, FLAGGED))
def flagged_sequences(spark, folder):
    rows = scored(spark, folder)
    return rows.select(
        *KEYS,
        "is_training",
        r6(F.col("reconstruction_error")).alias("reconstruction_error"),
        sc.flag(F.col("reconstruction_error")).alias("is_anomaly"),
    )


@query(
    "prediction_records",
    "D10",
    v.sql(
        v.SCORED + f""",
familiar0 as (select * from (with {v.FAMILIARITY.strip()} select * from familiar))""",
        f"""select sha256(concat_ws('|', s.sensor_id, cast(s.epoch as varchar), cast(s.seq_no as varchar))) as _id, s.last_ts as timestamp,
          {s6('s.reconstruction_error')} as reconstruction_error, s.reconstruction_error >= 0.5e0 as is_anomaly, s.is_training,
          false as is_false_positive, {s6('f.familiarity')} as familiarity
        from scored s join familiar0 f on s.sensor_id = f.sensor_id and s.epoch = f.epoch and s.seq_no = f.seq_no""",
    ),
)
def prediction_records(spark, folder):
    rows = sc.to_predictions(scored(spark, folder), F.col("ts"))
    return rows.select(
        "_id",
        "timestamp",
        r6(F.col("reconstruction_error")).alias("reconstruction_error"),
        "is_anomaly",
        "is_training",
        "is_false_positive",
        r6(F.col("familiarity")).alias("familiarity"),
    )


@query(
    "mean_reconstruction_model",
    "D6",
    v.sql(v.SCORED, "select cast(pos as int) as pos, " + ", ".join(f"{s6(f)} as {f}" for f in FEATURES) + " from model"),
)
def mean_reconstruction_model(spark, folder):
    model = sc.mean_model(sequences(spark, folder).filter("is_training"))
    rows = model.select(F.posexplode("reconstruction").alias("pos", "row"))
    return rows.select("pos", *[r6(F.get("row", F.lit(j))).alias(f) for j, f in enumerate(FEATURES)])


@query("subspace_model_scores", "D6, D9, U1, F14")
def subspace_model_scores(spark, folder):
    rows = settled_sequences(spark, folder)
    model = sc.fit_subspace(rows.filter("is_training"), 4)
    errors = sc.score_by_subspace(rows, model)
    return errors.select("_id", r6(F.col("reconstruction_error")).alias("reconstruction_error"))


CENTRE = """centre as (select label, list(m order by i) as c from (
    select label, i, avg(x) as m from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2) group by 1)"""
CELLS = f"""{CENTRE},
cells as (select e.vec_id, e.label, cast(e.embedding[i] as double) as x, c.c[i] as y, i from embeddings e join centre c on e.label = c.label, range(1, 65) t(i)),
errors as (select vec_id, any_value(label) as label, avg({v.smooth_l1_sql('x', 'y')}) as err from cells group by vec_id)"""


def embedding_errors(spark, folder):
    """Each vector against the mean vector of its label."""
    rows = table(spark, folder, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c"))
    joined = rows.join(centre, "label").withColumn("c", F.transform("c", lambda e: e["m"]))
    return joined.withColumn("reconstruction_error", losses.mean_smooth_l1(F.col("embedding"), F.col("c")))


@query("smooth_l1_losses", "D1", v.sql(CELLS, f"select vec_id, cast(i - 1 as int) as i, {s6(v.smooth_l1_sql('x', 'y'))} as loss from cells"))
def smooth_l1_losses(spark, folder):
    rows = embedding_errors(spark, folder)
    parts = F.zip_with("embedding", "c", losses.smooth_l1)
    return rows.select("vec_id", F.posexplode(parts).alias("i", "loss")).withColumn("loss", r6(F.col("loss")))


@query("sequence_errors", "D2", v.sql(CELLS, f"select vec_id, {s6('err')} as error from errors"))
def sequence_errors(spark, folder):
    return embedding_errors(spark, folder).select("vec_id", r6(F.col("reconstruction_error")).alias("error"))


@query("batch_loss", "D3", v.sql(CELLS, f"select label, {s6('avg(err)')} as loss from errors group by label"))
def batch_loss(spark, folder):
    rows = embedding_errors(spark, folder)
    return rows.groupBy("label").agg(r6(F.avg("reconstruction_error")).alias("loss"))


BATCHES = f"""{CELLS},
placed as (select *, (row_number() over (order by vec_id) - 1) // 32 as batch_no from errors),
batches as (select batch_no, avg(err) as loss, count(*) as "rows" from placed group by batch_no)"""


@query("batch_losses", "D4", v.sql(BATCHES, f'select batch_no, {s6("loss")} as loss, "rows" from batches'))
def batch_losses(spark, folder):
    return sc.batch_losses(embedding_errors(spark, folder), ["vec_id"]).withColumn("loss", r6(F.col("loss")))


@query("validation_loss", "D4", v.sql(BATCHES, f"select {s6('avg(loss)')} as loss from batches"))
def validation_loss(spark, folder):
    batches = sc.batch_losses(embedding_errors(spark, folder), ["vec_id"])
    return sc.validation_loss(batches).select(r6(F.col("loss")).alias("loss"))


@query(
    "epoch_average_loss",
    "D5",
    v.sql(
        v.METRICS + ",\nbatches as (select run_id, (step - 1) // 32 as batch_no, avg(val_loss) as loss from training_metrics group by 1, 2)",
        f"select run_id, {s6('coalesce(avg(loss), 0)')} as loss from batches group by run_id",
    ),
)
def epoch_average_loss(spark, folder):
    batch = F.floor((F.col("step") - 1) / 32).cast("long").alias("batch_no")
    batches = training_metrics(spark, folder).groupBy("run_id", batch).agg(F.avg("val_loss").alias("loss"))
    return batches.groupBy("run_id").agg(r6(F.coalesce(F.avg("loss"), F.lit(0.0))).alias("loss"))


@query(
    "train_validation_split",
    "D7",
    v.sql(v.PREDICTIONS, "select _id, row_number() over (order by timestamp, _id) <= floor(count(*) over () * 0.8e0) as is_train from predictions"),
)
def train_validation_split(spark, folder):
    return sc.split_exact(predictions(spark, folder), ["timestamp", "_id"]).select("_id", "is_train")


DRAWN = "md5(concat('{}|', _id))"


@query(
    "random_train_validation_split",
    "D7",
    v.sql(v.PREDICTIONS, f"select _id, row_number() over (order by {DRAWN.format(5)}, _id) <= floor(count(*) over () * 0.8e0) as is_train from predictions"),
)
def random_train_validation_split(spark, folder):
    return sc.split_random(predictions(spark, folder), seed=5).select("_id", "is_train")


@query(
    "three_way_split",
    "D8",
    v.sql(
        v.PREDICTIONS + f",\ndrawn as (select _id, cast(concat('0x', substr({DRAWN.format(0)}, 1, 8)) as bigint) / 4294967296e0 as draw from predictions)",
        "select _id, case when draw < 0.7e0 then 'train' when draw < 0.85e0 then 'validation' else 'test' end as part from drawn",
    ),
)
def three_way_split(spark, folder):
    return sc.split_three_ways(predictions(spark, folder), 0.7, 0.15).select("_id", "part")


@query(
    "fixed_threshold_flags",
    "D11",
    v.sql(v.PREDICTIONS, "select _id, reconstruction_error >= 0.5e0 as at_half, reconstruction_error >= 1 as at_one from predictions"),
)
def fixed_threshold_flags(spark, folder):
    error = F.col("reconstruction_error")
    return predictions(spark, folder).select("_id", sc.flag(error, 0.5).alias("at_half"), sc.flag(error, 1.0).alias("at_one"))


THRESHOLD = """
ranked as (select reconstruction_error, row_number() over (order by reconstruction_error, _id) as r, count(*) over () as n from predictions),
threshold as (select reconstruction_error as threshold from ranked where r = floor(n * 0.9e0) + 1)"""


@query("dynamic_threshold", "D12, G10", v.sql(v.PREDICTIONS + "," + THRESHOLD, f"select {s6('threshold')} as threshold from threshold"))
def dynamic_threshold(spark, folder):
    return sc.dynamic_threshold(predictions(spark, folder)).select(r6(F.col("threshold")).alias("threshold"))


@query(
    "dynamic_threshold_flags",
    "D12, D10",
    v.sql(v.PREDICTIONS + "," + THRESHOLD, "select _id, reconstruction_error >= (select threshold from threshold) as is_anomaly from predictions"),
)
def dynamic_threshold_flags(spark, folder):
    rows = predictions(spark, folder)
    limit = sc.dynamic_threshold(rows).scalar()
    return rows.select("_id", sc.flag(F.col("reconstruction_error"), limit).alias("is_anomaly"))


@query(
    "classwise_errors",
    "D13",
    v.sql(
        CELLS,
        f"select {s6('coalesce(avg(err) filter (where label % 2 = 0), 0)')} as normal_loss, {s6('coalesce(avg(err) filter (where label % 2 = 1), 0)')} as malicious_loss from errors",
    ),
)
def classwise_errors(spark, folder):
    rows = embedding_errors(spark, folder).withColumn("target", F.col("label") % 2)
    return sc.classwise_error(rows).select(r6(F.col("normal_loss")).alias("normal_loss"), r6(F.col("malicious_loss")).alias("malicious_loss"))


@query(
    "confusion_metrics",
    "D14",
    v.sql(
        """c as (select count(*) filter (where quality = 1 and toxic = 1) as tp, count(*) filter (where quality = 1 and toxic = 0) as fp,
          count(*) filter (where quality = 0 and toxic = 1) as fn, count(*) filter (where quality = 0 and toxic = 0) as tn from labels)""",
        f"""select tp, fp, fn, tn, {s6('(tp + tn) / nullif(tp + fp + fn + tn, 0)')} as accuracy, {s6('tp / nullif(tp + fp, 0)')} as "precision",
          {s6('tp / nullif(tp + fn, 0)')} as recall, {s6('2 * tp / nullif(2 * tp + fp + fn, 0)')} as f1 from c""",
    ),
)
def confusion_metrics(spark, folder):
    rows = table(spark, folder, "labels")
    found = sc.confusion_metrics(rows, F.col("quality") == 1, F.col("toxic") == 1)
    return found.withColumns({c: r6(F.col(c)) for c in ("accuracy", "precision", "recall", "f1")})


@query(
    "early_stopping",
    "D15",
    v.sql(
        v.METRICS + """,
best as (select run_id, step, val_loss, min(val_loss) over (partition by run_id order by step rows between unbounded preceding and 1 preceding) as earlier from training_metrics),
improved as (select *, max(case when earlier is null or val_loss < earlier then step end) over (partition by run_id order by step rows unbounded preceding) as best_step from best),
stops as (select run_id, min(step) as stopped_at from improved where step - best_step >= 5 group by run_id),
ends as (select i.run_id, any_value(s.stopped_at) as stopped_at, coalesce(any_value(s.stopped_at), max(i.step)) as steps from improved i left join stops s on i.run_id = s.run_id group by i.run_id)""",
        f"""select e.run_id, e.stopped_at, e.steps, i.best_step, {s6('m.val_loss')} as best_loss from ends e
          join improved i on e.run_id = i.run_id and e.steps = i.step join training_metrics m on m.run_id = e.run_id and m.step = i.best_step""",
    ),
)
def early_stopping(spark, folder):
    return sc.early_stopping(training_metrics(spark, folder)).withColumn("best_loss", r6(F.col("best_loss")))


def marked_registry(spark, folder):
    return model_registry(spark, folder).withColumn("is_best", F.col("validation_loss") < 0.02)


MARKED = v.REGISTRY + ",\nmarked as (select *, validation_loss < 0.02e0 as is_best from registry)"


@query(
    "registry_append",
    "D16",
    v.sql(
        MARKED,
        f"""select version, seq, checkpoint_path, {s6('validation_loss')} as validation_loss, creation_date, is_best from marked union all
        select concat('v', cast(max(seq) + 1 as varchar)), max(seq) + 1, '/models/checkpoints/next.bin', 0.125, timestamp '2024-02-01 00:00:00', true from marked""",
    ),
)
def registry_append(spark, folder):
    before = marked_registry(spark, folder).withColumn("creation_date", F.col("creation_date").cast("timestamp"))
    after = rg.append_version(before, "/models/checkpoints/next.bin", 0.125, "2024-02-01 00:00:00")
    return after.withColumns(
        {"validation_loss": r6(F.col("validation_loss")), "creation_date": F.col("creation_date").cast("timestamp_ntz")}
    )


REQUESTED = f"case when {v.K} % 4 = 0 then 'latest' when {v.K} % 4 = 1 then 'best' else concat('v', cast(event_id % 5000 as varchar)) end"


@query(
    "registry_resolve",
    "D17, J6",
    v.sql(
        MARKED + f""",
pointers as (select max_by(version, seq) as latest, max_by(version, seq) filter (where is_best) as best from marked),
requests as (select event_id as request_id, {REQUESTED} as requested from events),
concrete as (select r.*, case when requested = 'latest' then (select latest from pointers) when requested = 'best' then (select coalesce(best, latest) from pointers) else requested end as version from requests r)""",
        "select c.request_id, c.requested, c.version, m.checkpoint_path, m.checkpoint_path is null as untrained from concrete c left join marked m on c.version = m.version",
    ),
)
def registry_resolve(spark, folder):
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 4
    explicit = F.concat(F.lit("v"), (F.col("event_id") % 5000).cast("string"))
    asked = F.when(k == 0, "latest").when(k == 1, "best").otherwise(explicit)
    requests = table(spark, folder, "events").select(F.col("event_id").alias("request_id"), asked.alias("requested"))
    return rg.resolve(requests, marked_registry(spark, folder)).drop("validation_loss")


@query(
    "newest_checkpoint",
    "D18",
    v.sql(v.REGISTRY, "select max_by(checkpoint_path, creation_date) as path from registry"),
)
def newest_checkpoint(spark, folder):
    files = model_registry(spark, folder).select(
        F.col("checkpoint_path").alias("path"), F.col("creation_date").alias("modificationTime")
    )
    return rg.newest_checkpoint(files)


