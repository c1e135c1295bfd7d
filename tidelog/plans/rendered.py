"""Log lines rendered from the events table, with what each format's job must find in them.

Expressions are SQL that Spark and an oracle engine read alike, over the columns of ``EVENTS`` / ``EVENTS_SQL``. Every
13th event is an unparsable line. Five files: ``event_id % 5``; a file's lines are numbered by ``event_id div 5``.
"""

from __future__ import annotations

import re

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from tidelog.operators import parse as P

BAD = "'raw fallback ' || cast(event_id as string)"
REFERENCE = "2024-06-01 00:00:00"
_LEVELS = (("error", 5), ("purchase", 4), ("signup", 3), ("click", 2), ("view", 1))


def level(*names: str) -> str:
    """A name per event type, from error down to view."""
    return "case event_type " + " ".join(f"when '{e}' then '{n}'" for (e, _), n in zip(_LEVELS, names, strict=True)) + " end"


def graded(*numbers: int) -> str:
    return "case event_type " + " ".join(f"when '{e}' then {n}" for (e, _), n in zip(_LEVELS, numbers, strict=True)) + " end"


SEV = graded(5, 4, 3, 2, 1)

EVENTS_SQL = f"""
select event_id, event_id % 5 as file_id, event_id // 5 as line_no, event_id % 13 <> 0 as good, user_id, event_type, value,
       strftime(ts, '%Y-%m-%d') as d, strftime(ts, '%H:%M:%S') as t, strftime(ts, '%g') as ms3, strftime(ts, '%f') as us6,
       strftime(ts, '%b') as mon, strftime(ts, '%d') as dd, strftime(ts, '%m') as mm,
       epoch_us(ts) // 1000 as ms, epoch_us(ts) // 1000000 as secs, cast(user_id as string) as uid, cast(event_id as string) as eid,
       cast(cast(round(value * 100) as bigint) as string) as cents, {SEV} as sev from events"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns on Spark."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    text = lambda p: F.date_format("ts", p)
    return e.select(
        "event_id", (F.col("event_id") % 5).alias("file_id"), F.expr("event_id div 5").alias("line_no"), (F.col("event_id") % 13 != 0).alias("good"), "user_id", "event_type", "value",
        text("yyyy-MM-dd").alias("d"), text("HH:mm:ss").alias("t"), text("SSS").alias("ms3"), text("SSSSSS").alias("us6"), text("MMM").alias("mon"), text("dd").alias("dd"), text("MM").alias("mm"),
        F.unix_millis("ts").alias("ms"), F.unix_seconds("ts").alias("secs"), F.col("user_id").cast("string").alias("uid"), F.col("event_id").cast("string").alias("eid"),
        F.round(F.col("value") * 100).cast("bigint").cast("string").alias("cents"), F.expr(SEV).alias("sev"))


def lines(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    """``raw_lines`` of one rendering."""
    raw = F.when(F.col("good"), F.expr(line)).otherwise(F.expr(BAD))
    return events(spark, sf_dir).select("file_id", F.concat(F.lit("events/"), F.col("file_id").cast("string"), F.lit(".log")).alias("path"), "line_no", F.lit(None).cast("bigint").alias("byte_offset"), raw.alias("raw"))


# format -> (line, {field: text expression}, severity, instant in ms)
_ISO = "d || ' ' || t"
_SYS = "'host' || uid"
FORMATS: dict[str, tuple[str, dict[str, str], str, str]] = {
    "plaintext": ("event_type || ' ' || eid", {"Log": "event_type || ' ' || eid"}, "0", "null"),
    "alternatives": (f"'update-alternatives ' || {_ISO} || ': run ' || event_type", {"Time": _ISO, "Message": "'run ' || event_type"}, "0", "secs * 1000"),
    "apache-error": (
        f"'[Mon ' || mon || ' ' || dd || ' ' || t || '.' || us6 || ' 2024] [core:' || {level('error', 'warn', 'info', 'debug', 'trace1')} || '] [pid ' || uid || ':tid ' || eid || '] [client 10.0.0.1] ' || event_type",
        {"Time": "mon || ' ' || dd || ' ' || t || '.' || ms3", "Module": "'core'", "Level": level("error", "warn", "info", "debug", "trace1"), "PID": "uid", "TID": "eid", "Client": "'10.0.0.1'", "Message": "event_type"}, SEV, "ms"),
    "apport": (f"{level('ERROR', 'WARNING', 'INFO', 'DEBUG', 'TRACE')} || ': apport (pid ' || uid || ') ' || {_ISO} || ',' || ms3 || ': ' || event_type",
               {"Level": level("ERROR", "WARNING", "INFO", "DEBUG", "TRACE"), "PID": "uid", "Time": f"{_ISO} || ',' || ms3", "Message": "event_type"}, graded(5, 4, 3, 0, 0), "ms"),
    "apt-history": (f"{level('Error', 'Install', 'Upgrade', 'Remove', 'Purge')} || ': pkg' || eid", {"Key": level("Error", "Install", "Upgrade", "Remove", "Purge"), "Value": "'pkg' || eid"}, graded(5, 0, 0, 0, 0), "null"),
    "apt-term": (f"{level('Removing', 'Unpacking', 'Setting up', 'Log started', 'Log ended')} || ': pkg' || eid", {"Action": level("Removing", "Unpacking", "Setting up", "Log started", "Log ended"), "Details": "'pkg' || eid"}, "0", "null"),
    "audit": ("'node=n' || uid || ' type=' || upper(event_type) || ' msg=audit(' || cast(secs as string) || '.' || ms3 || ':' || eid || '): arch=c0'",
              {"Node": "'n' || uid", "Type": "upper(event_type)", "Time": "cast(secs as string) || '.' || ms3", "Serial": "eid", "Message": "'arch=c0'"}, "0", "ms"),
    "cef": (f"d || 'T' || t || 'Z h' || uid || ' CEF:0|Acme|Shop|1.0|' || eid || '|' || event_type || '|' || {level('8', '5', '2', 'low', 'unknown')} || '|src=10.0.0.1'",
            {"Time": "d || 'T' || t || 'Z'", "Host": "'h' || uid", "CEF Version": "'0'", "Vendor": "'Acme'", "Product": "'Shop'", "Product Version": "'1.0'", "Signature ID": "eid", "Name": "event_type", "Severity": level("8", "5", "2", "low", "unknown"), "Extensions": "'src=10.0.0.1'"}, graded(5, 4, 3, 3, 0), "secs * 1000"),
    "cloud-init": (f"{_ISO} || ',' || ms3 || ' - mod' || uid || '[' || {level('ERROR', 'WARNING', 'INFO', 'DEBUG', 'CRITICAL')} || ']: ' || event_type",
                   {"Time": f"{_ISO} || ',' || ms3", "Module": "'mod' || uid", "Level": level("ERROR", "WARNING", "INFO", "DEBUG", "CRITICAL"), "Message": "event_type"}, graded(5, 4, 3, 2, 6), "ms"),
    "cloud-init-output": ("'Cloud-init v. 22 running ' || event_type", {"Time": "''", "Module": "''", "Level": "''", "Message": "'Cloud-init v. 22 running ' || event_type"}, "0", "null"),
    "cri": (f"d || 'T' || t || '.' || us6 || 'Z ' || {level('stderr', 'stdout', 'stdout', 'stdout', 'stdout')} || ' F ' || event_type", {"Time": "d || 'T' || t || '.' || us6 || 'Z'", "Stream": level("stderr", "stdout", "stdout", "stdout", "stdout"), "Tag": "'F'", "Message": "event_type"}, "0", "ms"),
    "dmesg": ("'[ ' || eid || '.' || us6 || '] ' || event_type", {"Time": "eid || '.' || us6", "Message": "event_type"}, "0", "event_id * 1000 + cast(ms3 as bigint)"),
    "dpkg": (f"{_ISO} || ' ' || {level('remove', 'install', 'configure', 'status', 'startup')} || ' pkg' || eid", {"Time": _ISO, "Action": level("remove", "install", "configure", "status", "startup"), "Details": "'pkg' || eid"}, "0", "secs * 1000"),
    "keyvalue": (f"'ts=' || d || 'T' || t || '.' || ms3 || 'Z level=' || {level('error', 'warn', 'info', 'debug', 'trace')} || ' code=' || uid || ' msg=\"' || event_type || ' ' || eid || '\"'",
                 {"Timestamp": "d || 'T' || t || '.' || ms3 || 'Z'", "Level": level("error", "warn", "info", "debug", "trace"), "Code": "uid", "Message": "event_type || ' ' || eid"}, SEV, "ms"),
    "klog": (f"{level('E', 'W', 'I', 'F', 'I')} || mm || dd || ' ' || t || '.' || us6 || '    ' || uid || ' main.go:' || eid || '] ' || event_type",
             {"Level": level("E", "W", "I", "F", "I"), "Time": "mm || dd || ' ' || t || '.' || us6", "Thread": "uid", "Location": "'main.go:' || eid", "Message": "event_type"}, graded(5, 4, 3, 6, 3), "ms"),
    "leef": ("'LEEF:1.0|Acme|Shop|2|' || eid || '|src=' || uid", {"Time": "''", "Host": "''", "LEEF Version": "'1.0'", "Vendor": "'Acme'", "Product": "'Shop'", "Product Version": "'2'", "Event ID": "eid", "Delimiter": "''", "Extensions": "'src=' || uid"}, "0", "null"),
    "logback": (f"{_ISO} || ',' || ms3 || ' [main-' || uid || '] ' || {level('ERROR', 'WARN', 'INFO', 'DEBUG', 'TRACE')} || ' com.shop.' || event_type || ' - order ' || eid",
                {"Time": f"{_ISO} || ',' || ms3", "Thread": "'main-' || uid", "Level": level("ERROR", "WARN", "INFO", "DEBUG", "TRACE"), "Logger": "'com.shop.' || event_type", "Message": "'order ' || eid"}, SEV, "ms"),
    "nagios": ("'[' || cast(secs as string) || '] SERVICE ALERT: ' || event_type", {"Time": "cast(secs as string)", "Type": "'SERVICE ALERT'", "Message": "event_type"}, "0", "secs * 1000"),
    "nginx-error": (f"replace(d, '-', '/') || ' ' || t || ' [' || {level('error', 'warn', 'notice', 'debug', 'crit')} || '] ' || uid || '#0: *' || eid || ' open() failed'",
                    {"Time": "replace(d, '-', '/') || ' ' || t", "Level": level("error", "warn", "notice", "debug", "crit"), "PID": "uid", "TID": "'0'", "Connection": "eid", "Message": "'open() failed'"}, graded(5, 4, 3, 2, 6), "secs * 1000"),
    "s3-access": ("'own bkt [' || dd || '/' || mon || '/2024:' || t || ' +0100] 10.0.0.1 req ' || eid || ' REST.GET key' || uid || ' \"GET /k HTTP/1.1\" 200 - ' || cents || ' - 7 - \"-\" \"agent\" -'",
                  {"Bucket Owner": "'own'", "Bucket": "'bkt'", "Time": "dd || '/' || mon || '/2024:' || t || ' +0100'", "Remote IP": "'10.0.0.1'", "Requester": "'req'", "Request ID": "eid", "Operation": "'REST.GET'", "Key": "'key' || uid", "Request-URI": "'GET /k HTTP/1.1'", "Status": "'200'", "Error Code": "'-'", "Bytes Sent": "cents", "Object Size": "null", "Total Time": "'7'", "Turn-Around Time": "null", "Referrer": "'-'", "User-Agent": "'agent'", "Version ID": "'-'", "Extra": "''"}, "0", "secs * 1000 - 3600000"),
    "snort": (f"mm || '/' || dd || '-' || t || '.' || us6 || '  [**] [1:' || eid || ':1] ' || event_type || ' [**] [Priority: ' || {level('1', '2', '3', '4', '9')} || '] {{TCP}} 10.0.0.1:80 -> 10.0.0.2:' || uid",
              {"Time": "mm || '/' || dd || '-' || t || '.' || us6", "Signature": "'1:' || eid || ':1'", "Message": "event_type", "Classification": "''", "Priority": level("1", "2", "3", "4", "9"), "Protocol": "'TCP'", "Source": "'10.0.0.1:80'", "Destination": "'10.0.0.2:' || uid"}, graded(5, 4, 3, 1, 0), "ms"),
    "sysdig": ("eid || ' ' || cast(secs as string) || '.' || us6 || ' 1 proc' || uid || ' (' || uid || ') > ' || event_type || ' fd=1'",
               {"Event #": "eid", "Time": "cast(secs as string) || '.' || us6", "CPU": "'1'", "Process": "'proc' || uid", "TID": "uid", "Dir": "'>'", "Type": "event_type", "Info": "'fd=1'"}, "0", "ms"),
    "syslog-iso": (f"d || 'T' || t || '.' || us6 || '+02:00 ' || {_SYS} || ' app[' || uid || ']: ' || event_type", {"Time": "d || 'T' || t || '.' || us6 || '+02:00'", "Host": _SYS, "Process": "'app'", "PID": "uid", "Message": "event_type"}, "0", "ms - 7200000"),
    "syslog-rfc3164": (f"mon || '  ' || cast(cast(dd as int) as string) || ' ' || t || ' ' || {_SYS} || ' app[' || uid || ']: ' || event_type", {"Time": "mon || '  ' || cast(cast(dd as int) as string) || ' ' || t", "Host": _SYS, "Process": "'app'", "PID": "uid", "Message": "event_type"}, "0", "secs * 1000"),
    "xorg": (f"'[ ' || eid || '.' || ms3 || '] (' || {level('EE', 'WW', 'II', 'NI', '--')} || ') ' || event_type", {"Time": "eid || '.' || ms3", "Marker": level("EE", "WW", "II", "NI", "--"), "Message": "event_type"}, graded(5, 4, 3, 4, 0), "event_id * 1000 + cast(ms3 as bigint)"),
    "logcat": (f"mm || '-' || dd || ' ' || t || '.' || ms3 || ' ' || uid || ' ' || eid || ' ' || {level('E', 'W', 'I', 'D', 'V')} || ' Tag' || cast(user_id % 5 as string) || ': ' || event_type",
               {"Time": "mm || '-' || dd || ' ' || t || '.' || ms3", "PID": "uid", "TID": "eid", "Level": level("Error", "Warning", "Info", "Debug", "Verbose"), "Tag": "'Tag' || cast(user_id % 5 as string)", "Message": "event_type"}, SEV, "ms"),
    "clf": ("'10.0.0.' || cast(user_id % 250 as string) || ' - u' || uid || ' [' || dd || '/' || mon || '/2024:' || t || ' -0700] \"GET /' || event_type || ' HTTP/1.1\" ' || cast(200 + event_id % 5 as string) || ' -'",
            {"Remote Host": "'10.0.0.' || cast(user_id % 250 as string)", "Identity": "'-'", "User ID": "'u' || uid", "Timestamp": "dd || '/' || mon || '/2024:' || t || ' -0700'", "Method": "'GET'", "Path": "'/' || event_type", "Protocol": "'HTTP/1.1'", "Status": "cast(200 + event_id % 5 as string)", "Bytes": "'0'"}, "0", "secs * 1000 + 25200000"),
    "jsonlines": (f"'{{\"ts\":\"' || d || 'T' || t || '.' || ms3 || 'Z\",\"level\":\"' || {level('error', 'warn', 'info', 'debug', 'trace')} || '\",\"name\":\"u' || uid || '\",\"msg\":\"' || event_type || ' ' || eid || '\"}}'",
                  {"Timestamp": "d || 'T' || t || '.' || ms3 || 'Z'", "Level": level("Error", "Warning", "Info", "Debug", "Verbose"), "Source": "'u' || uid", "Message": "event_type || ' ' || eid"}, SEV, "ms"),
    "docker": (f"'{{\"log\":\"' || event_type || ' ' || eid || '\\\\n\",\"stream\":\"' || {level('stderr', 'stdout', 'stdout', 'stdout', 'stdout')} || '\",\"time\":\"' || d || 'T' || t || '.' || us6 || 'Z\"}}'",
               {"Time": "d || 'T' || t || '.' || us6 || 'Z'", "Stream": level("stderr", "stdout", "stdout", "stdout", "stdout"), "Message": "event_type || ' ' || eid"}, "0", "ms"),
    "gelf": (f"'{{\"version\":\"1.1\",\"host\":\"h' || uid || '\",\"short_message\":\"' || event_type || '\",\"timestamp\":' || cast(secs as string) || '.' || ms3 || ',\"level\":' || {level('3', '4', '6', '7', '0')} || ',\"_b\":' || eid || ',\"_a\":\"x\",\"_id\":1}}'",
             {"Timestamp": None, "Level": level("Error", "Warning", "Info", "Debug", "Fatal"), "Host": "'h' || uid", "Message": "event_type", "Extra": "'{\"_a\":\"x\",\"_b\":' || eid || '}'"}, graded(5, 4, 3, 2, 6), None),
}


def plain(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def fields_of(fmt: str):
    named = {"logcat": P.LOGCAT_FIELDS, "clf": P.CLF_FIELDS}
    return named[fmt] if fmt in named else P.builtin_spec(fmt).fields if fmt in P.SPECS else None


def parsed(spark: SparkSession, sf_dir: str, fmt: str, files: str = "true") -> DataFrame:
    """The job's events of the rendered lines, of the wanted files."""
    source = lines(spark, sf_dir, FORMATS[fmt][0]).filter(files)
    if fmt == "logcat" or fmt in P.SPECS:
        return P.parse(source, fmt, reference=F.lit(REFERENCE).cast("timestamp"))
    return P.parse(source, fmt)


def parse_query(fmt: str):
    """Events of all rendered lines with plain column names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = parsed(spark, sf_dir, fmt)
        _, values, _, ms = FORMATS[fmt]
        return df.select("file_id", "line_no", "ok", "severity", *(["ts_ms"] if ms else []), *[F.col(f"`{P.shown(k)}`").alias("f_" + plain(k)) for k, v in values.items() if v])

    return run


def parse_oracle(fmt: str) -> str:
    """What the job must find, from the events themselves."""
    line, values, severity, ms = FORMATS[fmt]
    kinds = {f.name: f for f in fields_of(fmt) or ()}
    message = next((f.name for f in kinds.values() if f.hint == "message"), {"plaintext": "Log"}.get(fmt, "Message"))
    good = "true" if fmt == "plaintext" else "good"
    cells = []
    for name, value in values.items():
        if not value:
            continue
        other = BAD if name == message else "''"
        integer = name in kinds and kinds[name].type == "integer"
        cells.append(f"case when good then {f'cast({value} as bigint)' if integer else value} else {'null' if integer else other} end as f_{plain(name)}")
    instant = [f"cast(case when good then {ms} end as bigint) as ts_ms"] if ms else []
    return f"with e as ({EVENTS_SQL}) select file_id, line_no, {good} as ok, cast(case when good then {severity} else 0 end as tinyint) as severity, {', '.join(instant + cells)} from e"
