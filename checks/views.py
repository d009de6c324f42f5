"""Oracle SQL for the derived tables, composed as WITH lists."""

from __future__ import annotations

from netweave.schemas import FEATURES

RESET = 1000
LENGTH = 16
TRAINING_BEFORE = "2024-01-08 00:00:00"
FEATURE_LIST = ", ".join(FEATURES)

K = "cast(regexp_extract(props, '[0-9]+', 0) as int)"

PACKETS = f"""
with_k as (select event_id, ts, user_id, event_type, {K} as k from events),
with_proto as (
  select *, case when event_type in ('view', 'click') then 6 when event_type = 'signup' then 17
    when event_type = 'error' then 1 when k % 10 = 0 then 2 when k % 10 = 1 then null
    when k % 10 = 2 then 47 else 17 end as proto from with_k),
packets as (
  select event_id as packet_id, concat('s', cast(user_id % 4 as varchar)) as sensor_id, ts,
    case when proto is not null then concat('10.0.', cast(user_id % 3 as varchar), '.', cast(user_id % 256 as varchar)) end as src_ip,
    case when proto is not null then concat('192.168.', cast(k % 4 as varchar), '.', cast(1 + k % 7 as varchar)) end as dst_ip,
    cast(case when proto is not null then 40 + (event_id * 37) % 1460 end as int) as ip_len,
    cast(case when proto is not null then case when k = 99 then 2 else 5 end end as int) as ihl,
    cast(case when proto is not null then (k % 4) * 2 % 8 end as int) as ip_flags,
    cast(case when proto is not null then 32 + k end as int) as ttl,
    cast(proto as int) as proto,
    cast(case when proto in (6, 17) then 1024 + (event_id * 7919) % 64512 end as int) as src_port,
    cast(case when proto in (6, 17) then case k % 6 when 0 then 80 when 1 then 443 when 2 then 53 when 3 then 22
      when 4 then 8080 else 1 + (event_id * 13) % 1000 end end as int) as dst_port,
    cast(case when proto = 6 then case k % 5 when 0 then 2 when 1 then 18 when 2 then 16 when 3 then 24 else 4 end end as int) as tcp_flags,
    cast(case when proto = 6 then (event_id * 131) % 65536 end as int) as tcp_window,
    cast(case when proto = 17 then 20 + (event_id * 37) % 1460 end as int) as udp_len,
    cast(case when proto is null then 42 else 54 + (event_id * 37) % 1460 end as int) as packet_size
  from with_proto)"""


def ip_sql(ip: str) -> str:
    parts = [f"cast(split_part({ip}, '.', {i}) as bigint)" for i in range(1, 5)]
    return f"({parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]})"


def ip_scaled_sql(ip: str) -> str:
    return f"({ip_sql(ip)} / 4294967295.0e0 * 2 - 1)"


def log_sql(field: str) -> str:
    return f"(ln(1.0e0 + {field}) / ln(65536.0e0) * 2 - 1)"


def byte_sql(field: str) -> str:
    return f"({field} / 127.5e0 - 1)"


FEATURE_SQL = {
    "f0": ip_scaled_sql("src_ip"),
    "f1": ip_scaled_sql("dst_ip"),
    "f2": log_sql("ip_len"),
    "f3": "(ip_flags / 3.5e0 - 1)",
    "f4": byte_sql("ttl"),
    "f5": byte_sql("proto"),
    "f6": f"(case when proto in (6, 17) then {log_sql('src_port')} else -1.0e0 end)",
    "f7": f"(case when proto in (6, 17) then {log_sql('dst_port')} else -1.0e0 end)",
    "f8": f"(case when proto = 6 then {byte_sql('tcp_flags')} when proto = 17 then {log_sql('udp_len')} else -1.0e0 end)",
    "f9": f"(case when proto = 6 then {log_sql('tcp_window')} else -1.0e0 end)",
    "f10": "(-1.0e0)",
    "f11": log_sql("packet_size"),
}

NAME_SQL = "case proto when 1 then 'ICMP' when 2 then 'IGMP' when 6 then 'TCP' when 17 then 'UDP' else 'Unknown' end"

EPOCHS = f"""{PACKETS},
arrived as (select *, row_number() over (partition by sensor_id order by ts, packet_id) as arrival from packets),
epochs as (select *, cast(floor((arrival - 1) / {RESET}.0e0) as bigint) as epoch from arrived)"""

PLACED = f"""{EPOCHS},
usable as (
  select *, ts < timestamp '{TRAINING_BEFORE}' as is_training,
    row_number() over (partition by sensor_id, epoch order by arrival) - 1 as vi,
    count(*) over (partition by sensor_id, epoch) as n
  from epochs where proto is not null),
placed as (
  select *, vi // {LENGTH} as seq_no, cast(vi % {LENGTH} as int) as pos from usable where vi // {LENGTH} < n // {LENGTH})"""

PAIRS = f"""{PLACED},
marked as (
  select *, cast(vi = min(vi) over (partition by sensor_id, epoch, src_ip, dst_ip) as int) as new_pair,
    min(case when is_training then vi end) over (partition by sensor_id, epoch, src_ip, dst_ip) as first_trained
  from placed),
running_pairs as (
  select *,
    cast(sum(new_pair) over (partition by sensor_id, epoch order by vi rows unbounded preceding) as bigint) as seen,
    cast(sum(case when vi = first_trained then 1 else 0 end)
      over (partition by sensor_id, epoch order by vi rows unbounded preceding) as bigint) as trained
  from marked)"""

FAMILIARITY = f"""{PAIRS},
familiar as (
  select sensor_id, epoch, seq_no, max(seen) as seen, max(trained) as trained,
    case when max(trained) = 0 then 0.0e0 else 1 - max(trained) / cast(max(seen) as double) end as familiarity
  from running_pairs group by sensor_id, epoch, seq_no)"""

GAPS = f"""{PLACED},
gaps as (
  select *, case when pos > 0 then (epoch_us(ts) - lag(epoch_us(ts)) over (partition by sensor_id, epoch order by vi)) / 1e6 end as gap
  from placed),
seq_gaps as (
  select sensor_id, epoch, seq_no, avg(gap) as mean_gap, max_by(is_training, pos) as is_training, max_by(ts, pos) as last_ts
  from gaps group by sensor_id, epoch, seq_no)"""

_ROW = ", ".join(
    f"ln(1 + g.mean_gap) / ln(2.0e0) * 2 - 1 as f3" if f == "f3" else f"{FEATURE_SQL[f]} as {f}" for f in FEATURES
)
ROWS = f"""{GAPS},
feature_rows as (
  select p.sensor_id, p.epoch, p.seq_no, p.pos, g.is_training, g.last_ts, {_ROW}
  from placed p join seq_gaps g on p.sensor_id = g.sensor_id and p.epoch = g.epoch and p.seq_no = g.seq_no)"""


def params_sql(where: str) -> str:
    cells = ", ".join(
        f"quantile_cont({f}, 0.5) as m_{f}, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) as q_{f}" for f in FEATURES
    )
    return f"select sensor_id, epoch, {cells} from feature_rows where {where} group by sensor_id, epoch"


SCALED_CELLS = ", ".join(
    f"(r.{f} - p.m_{f}) / (case when p.q_{f} < 1e-12 then 1.0e0 else p.q_{f} end) as {f}" for f in FEATURES
)


def scaled_ctes(where: str) -> str:
    return f"""{ROWS},
params as ({params_sql(where)}),
scaled as (
  select r.sensor_id, r.epoch, r.seq_no, r.pos, r.is_training, r.last_ts, {SCALED_CELLS}
  from feature_rows r join params p on r.sensor_id = p.sensor_id and r.epoch = p.epoch)"""


SCALED = scaled_ctes("seq_no = 0")


def smooth_l1_sql(x: str, y: str) -> str:
    d = f"abs({x} - {y})"
    return f"(case when {d} < 1 then {d} * {d} / 2 else {d} - 0.5e0 end)"


MODEL_CELLS = ", ".join(f"avg({f}) as {f}" for f in FEATURES)
ERROR_SUM = " + ".join(smooth_l1_sql(f"s.{f}", f"m.{f}") for f in FEATURES)
SCORED = f"""{SCALED},
model as (select pos, {MODEL_CELLS} from scaled where is_training group by pos),
scored as (
  select s.sensor_id, s.epoch, s.seq_no, max(s.last_ts) as last_ts, bool_or(s.is_training) as is_training,
    sum({ERROR_SUM}) / 192.0e0 as reconstruction_error
  from scaled s join model m on s.pos = m.pos group by s.sensor_id, s.epoch, s.seq_no)"""

_CELLS = ",".join(["0.1"] * 12)
_SHORT = ",".join(["0.1"] * 11)
MESSAGES = f"""
raw_messages as (
  select event_id as offset_no, ts as record_ts, concat('m', cast(event_id as varchar)) as msg_key,
    case when event_id % 20 = 0 then concat('{{"_id":"m', cast(event_id as varchar), '",')
    else concat('{{"_id":"m', cast(event_id as varchar), '","timestamp":"2024-01-01T00:00:00.000","sequence":[',
      case when event_id % 20 = 5 then '[{_SHORT}]' else '[{_CELLS}]' end,
      repeat(',[{_CELLS}]', case when event_id % 20 = 3 then 14 else 15 end),
      '],"human_readable":[{{"src_ip":"10.0.0.1"}}',
      repeat(',{{"src_ip":"10.0.0.1"}}', case when event_id % 20 in (3, 4) then 14 else 15 end), '],',
      case when event_id % 20 = 2 then '' when user_id % 5 = 0 then '"is_training":true,' else '"is_training":false,' end,
      case when event_id % 20 = 1 then '' else '"familiarity":0.25,' end,
      '"is_anomaly":false,"is_false_positive":false,"reconstruction_error":null}}') end as value
  from events)"""


def has_keys_sql(keys: list[str]) -> str:
    wanted = ", ".join(f"'{k}'" for k in keys)
    return f"list_has_all(json_keys(value), [{wanted}])"


PREDICTIONS = f"""
predictions as (
  select concat('m', cast(event_id as varchar)) as _id, ts as timestamp, value / 500 as reconstruction_error,
    value / 500 >= 0.5e0 as is_anomaly, user_id % 5 = 0 as is_training, false as is_false_positive,
    cast({K} as double) / 100 as familiarity
  from events),
anomalies as (select * from predictions where is_anomaly)"""

FEEDBACK = f"""
feedback as (
  select case when {K} % 10 = 0 then null when {K} % 10 = 1 then concat('x', cast(event_id as varchar))
    else concat('m', cast(event_id as varchar)) end as _id, ts as marked_at
  from events where value > 300 or event_type = 'signup')"""

STAGE_LOG = """
stage_log as (
  select concat('m', cast(event_id % 500 as varchar)) as _id,
    case event_type when 'view' then 'raw' when 'click' then 'processed' when 'signup' then 'training'
      when 'purchase' then 'predictions' else 'labeled' end as stage,
    case event_type when 'view' then 0 when 'click' then 1 when 'signup' then 2 when 'purchase' then 3 else 4 end as stage_rank,
    ts as timestamp, value / 500 as reconstruction_error
  from events)"""

METRICS = """
training_metrics as (
  select user_id % 10 as run_id, row_number() over (partition by user_id % 10 order by event_id) as step,
    value / 100 as val_loss from events)"""

REGISTRY = """
registry as (
  select concat('v', cast(row_number() over (order by event_id) as varchar)) as version,
    row_number() over (order by event_id) as seq,
    concat('/models/checkpoints/m_', cast(event_id as varchar), '.bin') as checkpoint_path,
    value / 500 as validation_loss, ts as creation_date
  from events where event_type = 'purchase')"""

JOBS = f"""
job_status as (
  select concat('job', cast(user_id as varchar)) as job_id, ts as event_ts, event_type as status,
    {K} as progress, props as message from events)"""


def sql(ctes: str, body: str) -> str:
    return f"with {ctes.strip()}\n{body}"
