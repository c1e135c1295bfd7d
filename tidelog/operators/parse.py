"""Parse jobs: raw lines to typed events of one format.

Every job keeps the line's columns and adds ``format``, ``ok``, ``severity`` (TINYINT 0..6), ``ts_text``, ``ts_ms`` and a
column per field. On a mismatch the message field holds the whole line, the others are empty, ``ok`` is false and the
severity 0. Integer fields are BIGINT, null where the text is no integer. Patterns search the line.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from tidelog.functions import severity as sev
from tidelog.functions.predicates import pattern_error
from tidelog.functions.timecol import found, groups, let, normalize_time
from tidelog.operators.formats import SPECS, Field

KEYS = ("file_id", "path", "line_no", "raw")


@dataclass(frozen=True)
class Spec:
    id: str
    pattern: str
    fields: tuple[Field, ...]
    severity: tuple[str, dict[str, str], str] | None = None
    specificity: float = 0.9
    extra: dict = field(default_factory=dict)


def spec_rules(spec: Spec) -> None:
    """Raise ValueError where a spec can't be a job."""
    captures = group_numbers(spec.pattern)
    names = [f.name.lower() for f in spec.fields]
    problems = [
        (not spec.id, "no id"), (not spec.fields, "no fields"), (len(set(names)) < len(names), "field names repeat"),
        (any(f.capture not in captures for f in spec.fields), "a field's capture is not in the pattern"),
        (any(f.type not in ("string", "integer", "datetime") for f in spec.fields), "unknown type"),
        (any(f.hint not in ("", "numeric", "timestamp", "severityname", "identifier", "message") for f in spec.fields), "unknown hint"),
        (any(f.time_format and f.type != "datetime" for f in spec.fields), "a time format on a field that is no datetime"),
        (sum(f.hint == "message" for f in spec.fields) != 1, "not exactly one message field"),
        (not 0 < spec.specificity <= 1, "specificity out of (0, 1]"),
        (spec.severity is not None and (spec.severity[0] not in captures or not {*spec.severity[1].values(), spec.severity[2]} <= set(sev.NAMES)), "bad severity"),
    ]
    for wrong, what in problems:
        if wrong:
            raise ValueError(f"format {spec.id or '?'}: {what}")
    if (why := pattern_error(spec.pattern)) is not None:
        raise ValueError(f"format {spec.id}: the pattern doesn't compile: {why}")


def group_numbers(pattern: str) -> dict[str, int]:
    """Number of each named group; unnamed groups count too."""
    plain = re.sub(r"\\.", "__", pattern)
    plain = re.sub(r"\[\^?\]?[^\]]*\]", lambda m: "_" * len(m[0]), plain)
    found, n = {}, 0
    for m in re.finditer(r"\((?:\?<([A-Za-z]\w*)>|(?!\?))", plain):
        n += 1
        if m[1]:
            found[m[1]] = n
    return found


def builtin_spec(name: str) -> Spec:
    raw = SPECS[name]
    return Spec(name, raw["pattern"], tuple(raw["fields"]), raw.get("severity"), raw["specificity"])


def registry(specs: Sequence[Spec]) -> dict[str, Spec]:
    """Checked specs by id; later ones override earlier ones."""
    for s in specs:
        spec_rules(s)
    return {s.id: s for s in specs}


def columns_of(df: DataFrame, hint: str) -> list[str]:
    return [f.name for f in df.schema.fields if f.metadata.get("hint") == hint]


def time_column(df: DataFrame) -> str | None:
    """The first timestamp-hinted column, else the first datetime."""
    found = columns_of(df, "timestamp") or [f.name for f in df.schema.fields if f.metadata.get("type") == "datetime"]
    return found[0] if found else None


def message_column(df: DataFrame) -> str:
    found = columns_of(df, "message")
    return found[0] if found else df.columns[-1]


COMMON = ("file_id", "path", "line_no", "byte_offset", "raw", "format", "ok", "severity", "ts_text", "ts_ms")


def shown(name: str) -> str:
    """A field's column: its name, with ``_`` after it where a common column has the name already."""
    return name + "_" * (name.lower() in COMMON)


def _typed(value: Column, f: Field) -> Column:
    out = sev.number_of(F.trim(value), "bigint") if f.type == "integer" else value
    return out.alias(shown(f.name), metadata={"hint": f.hint, "type": f.type, "timeFormat": f.time_format})


def events(lines: DataFrame, fmt: str, fields: Sequence[Field], values: dict[str, Column], ok: Column, severity: Column | None = None,
           zone: str = "UTC", reference: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The common contract of all jobs, of the values of a matching line.

    With ``columns``, only those of the made columns are made: what a row's barrier holds is computed, wanted or not.
    """
    message = next((f.name for f in fields if f.hint == "message"), fields[-1].name)
    ok = F.coalesce(ok, F.lit(False))
    filled = {f.name: F.when(F.col("_ok"), F.coalesce(values[f.name], F.lit(""))).otherwise(F.col("raw") if f.name == message else F.lit("")) for f in fields}
    time = next((f for f in fields if f.hint == "timestamp"), next((f for f in fields if f.type == "datetime"), None))
    made = {"format", "ok", "severity", "ts_text", "ts_ms", "_ok", *(shown(f.name).lower() for f in fields)}
    keys = [c for c in lines.columns if c.lower() not in made]
    level = (F.when(F.col("_ok"), severity).otherwise(F.lit(0)) if severity is not None else F.lit(0)).cast("tinyint")
    ms = normalize_time(filled[time.name], time.time_format, zone, reference) if time else F.lit(None).cast("bigint")
    all_columns = ["format", "ok", "severity", "ts_text", "ts_ms", *(shown(f.name) for f in fields)]
    wanted = {c.lower() for c in all_columns if columns is None or c.lower() in {x.lower() for x in columns}}
    needed = lambda f: shown(f.name).lower() in wanted or (f is time and "ts_text" in wanted)
    made = {"_ok": F.col("_ok"), "severity": level, "ts_ms": ms}
    made = {k: v for k, v in made.items() if k == "_ok" or k in wanted} | {f"_v{i}": filled[f.name] for i, f in enumerate(fields) if needed(f)}
    rows = once(lines.withColumn("_ok", ok), keys, made)
    place = {f.name: F.col(f"_v{i}") for i, f in enumerate(fields)}
    text = place[time.name] if time else F.lit("")
    out = {"format": F.lit(fmt).alias("format"), "ok": F.col("_ok").alias("ok"), "severity": F.col("severity"), "ts_text": text.alias("ts_text"), "ts_ms": F.col("ts_ms")}
    return rows.select(*keys, *[v for k, v in out.items() if k in wanted], *[_typed(place[f.name], f) for f in fields if shown(f.name).lower() in wanted])


def once(df: DataFrame, keep: Sequence[str], made: dict[str, Column]) -> DataFrame:
    """Columns ``keep`` and what is ``made`` of a row, computed there and only there.

    A filter on such a column doesn't reach below (it would compute the column again for every mention).
    """
    return df.select(*[F.col(f"`{k}`") for k in keep], F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def captured(lines: DataFrame, pattern: str, numbers: Sequence[int]) -> DataFrame:
    """Add ``_parts``, what ``groups`` finds in ``raw``."""
    return once(lines, lines.columns, {"_parts": groups(F.col("raw"), pattern, numbers)})


def parse_spec(lines: DataFrame, spec: Spec, zone: str = "UTC", reference: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Run a declared format."""
    numbers = group_numbers(spec.pattern)
    wanted = list(dict.fromkeys([*(f.capture for f in spec.fields), *([spec.severity[0]] if spec.severity else [])]))
    lines = captured(lines, spec.pattern, [numbers[n] for n in wanted])
    capture = lambda name: F.get("_parts", F.lit(wanted.index(name) + 1))
    severity = None
    if spec.severity:
        source, names, default = spec.severity
        severity = sev.lookup(F.lower(capture(source)), {k: sev.NAMES.index(v) for k, v in names.items()}, sev.NAMES.index(default))
    return events(lines, spec.id, spec.fields, {f.name: capture(f.capture) for f in spec.fields}, found(F.col("_parts"), len(wanted)), severity, zone, reference, columns).drop("_parts")


def pattern_spec(pattern: str, name: str = "pattern") -> Spec:
    """An ad-hoc pattern as a spec: a field per named group, ``message``/``msg`` (else the last) the message,
    ``level``/``severity`` the severity by standard names."""
    groups = sorted(group_numbers(pattern).items(), key=lambda x: x[1])
    if not groups:
        raise ValueError("the pattern has no named group")
    captures = [g for g, _ in groups]
    message = next((c for c in captures if c.lower() in ("message", "msg")), captures[-1])
    level = next((c for c in captures if c.lower() in ("level", "severity")), None)
    fields = tuple(Field(c[0].upper() + c[1:], c, "string", "message" if c == message else "severityname" if c == level else "") for c in captures)
    names = {k: sev.NAMES[v] for k, v in {**sev.ALIASES, **{n: i for i, n in enumerate(sev.NAMES)}}.items()}
    return Spec(name, pattern, fields, (level, names, "none") if level else None, 0.8)


def parse_pattern(lines: DataFrame, pattern: str) -> DataFrame:
    spec = pattern_spec(pattern)
    spec_rules(spec)
    return parse_spec(lines, spec)


# The patterns of the logcat variants in the order they are tried, with the groups that hold time, pid,
# tid, level, tag and message (0: none), and the pattern of the common log format.
LOGCAT = (
    (r"(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+(\d+)\s+(\d+)\s+([VDIWEF])\s+([^:]+):\s*(.*)", (1, 2, 3, 4, 5, 6)),
    (r"\[\s*(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+(\d+):\s*(\d+)\s+([VDIWEF])/([^\]]+)\s*\]\s*(.*)", (1, 2, 3, 4, 5, 6)),
    (r"(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3})\s+([VDIWEF])/([^(]+?)\s*\(\s*(\d+)\):\s*(.*)", (1, 4, 0, 2, 3, 5)),
    (r"([VDIWEF])/([^(:]+)\(\s*(\d+)\):\s+(.*)", (0, 3, 0, 1, 2, 4)),
    (r"^([VDIWEF])\(\s*(\d+)\)\s+(.*?)\s+\(([^)]+)\)$", (0, 2, 0, 1, 4, 3)),
    (r"([VDIWEF])\(\s*(\d+):\s*(\d+)\)\s+(.*)", (0, 2, 3, 1, 0, 4)),
    (r"([VDIWEF])/([^:]+):\s*(.*)", (0, 0, 0, 1, 2, 3)),
)
LOGCAT_FIELDS = (
    Field("Time", "", "datetime", "timestamp", "MM-dd HH:mm:ss.zzz"), Field("PID", "", "integer", "numeric"), Field("TID", "", "integer", "numeric"),
    Field("Level", "", "string", "severityname"), Field("Tag", "", "string", "identifier"), Field("Message", "", "string", "message"),
)
CLF = r'^(\S+) (\S+) (\S+) \[([\w:/]+\s[+\-]\d{4})\] "([^"]*)" (\d{3}) (\d+|-)'
CLF_FIELDS = (
    Field("Remote Host", "", "string", "identifier"), Field("Identity"), Field("User ID"), Field("Timestamp", "", "datetime", "timestamp", "clf"),
    Field("Method"), Field("Path", "", "string", "message"), Field("Protocol"), Field("Status", "", "integer", "numeric"), Field("Bytes", "", "integer", "numeric"),
)
JSON_KEYS = {
    "Timestamp": ("timestamp", "time", "ts", "@timestamp", "__REALTIME_TIMESTAMP", "timeMillis", "instant"),
    "Level": ("level", "severity", "lvl", "PRIORITY"),
    "Source": ("SYSLOG_IDENTIFIER", "_SYSTEMD_UNIT", "logger", "loggerName", "name", "tag"),
    "Message": ("message", "msg", "MESSAGE"),
}
W3C_INTEGERS = ("sc-status", "sc-substatus", "sc-win32-status", "sc-bytes", "cs-bytes", "time-taken", "s-port")
W3C_IDENTIFIERS = ("c-ip", "s-ip", "cs-username", "s-computername", "s-sitename")


def parse_plaintext(lines: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return events(lines, "plaintext", (Field("Log", "", "string", "message"),), {"Log": F.col("raw")}, F.lit(True), columns=columns)


def parse_logcat(lines: DataFrame, zone: str = "UTC", reference: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """The seven variants, first match first; tags are trimmed."""
    names, n = [f.name for f in LOGCAT_FIELDS], len(LOGCAT_FIELDS)
    tries = [let(groups(F.col("raw"), pattern, numbers), lambda p: F.when(found(p, n), p)) for pattern, numbers in LOGCAT]
    lines = once(lines, lines.columns, {"_parts": F.coalesce(*tries)})
    hit = lambda k: F.get("_parts", F.lit(k + 1))
    level = sev.lookup(hit(3), {"V": 1, "D": 2, "I": 3, "W": 4, "E": 5, "F": 6}, 0)
    values = {name: hit(k) for k, name in enumerate(names)} | {"Level": sev.display_name(level), "Tag": F.trim(hit(4))}
    return events(lines, "logcat", LOGCAT_FIELDS, values, F.col("_parts").isNotNull(), level, zone, reference, columns).drop("_parts")


def parse_clf(lines: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Common and combined access logs; the time's offset is honoured, ``-`` bytes count 0."""
    lines = captured(lines, CLF, range(1, 8))
    group = lambda i: F.get("_parts", F.lit(i))
    parts = F.split(group(5), " ", -1)
    request = lambda i: F.when(F.size(parts) >= 3, parts[i]).otherwise("")
    values = {
        "Remote Host": group(1), "Identity": group(2), "User ID": group(3), "Timestamp": group(4), "Method": request(0), "Path": request(1),
        "Protocol": request(2), "Status": group(6), "Bytes": F.when(group(7) == "-", "0").otherwise(group(7)),
    }
    return events(lines, "clf", CLF_FIELDS, values, found(F.col("_parts"), 7), columns=columns).drop("_parts")


def json_text(value: Column) -> Column:
    """A JSON value's raw text as a field: strings plain, whole numbers as integers, null as empty."""
    plain = lambda n, text: F.when((F.abs(n) < 9e15) & (n == F.floor(n)), n.cast("bigint").cast("string")).otherwise(text)
    as_number = lambda v: let(v.try_cast("double"), lambda n: plain(n, v))
    return let(value, lambda v: F.when(F.rlike(v, F.lit(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")), as_number(v)).otherwise(F.coalesce(v, F.lit(""))))


def _json_first(keys: Sequence[str]) -> Column:
    """(key, text) of the first key that the object has, a null value included."""
    path = lambda k: F.get_json_object("raw", f"$['{k}']")
    return F.coalesce(*[F.when(F.array_contains("_keys", k), F.struct(F.lit(k).alias("key"), json_text(path(k)).alias("text"))) for k in keys])


def _with_keys(lines: DataFrame) -> DataFrame:
    """``_keys``: names of the line's JSON object; null if the line is none."""
    braced = F.when(F.rlike("raw", F.lit(r"^\s*\{")), F.col("raw"))  # what is no JSON throws within Spark
    return once(lines, lines.columns, {"_keys": F.when(F.try_parse_json(braced).isNotNull(), F.json_object_keys("raw"))})


def parse_jsonlines(lines: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A JSON object per line; the first alias that is present gives a field, present nulls are empty."""
    rows = _with_keys(lines).withColumns({f"_{k}": _json_first(v) for k, v in JSON_KEYS.items()})
    stamp = F.col("_Timestamp")
    iso = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    micros = sev.number_of(stamp["text"], "bigint")
    nested = lambda k: F.get_json_object("raw", f"$.instant.{k}").try_cast("bigint")
    time = (F.when((stamp["key"] == "__REALTIME_TIMESTAMP") & micros.isNotNull(), iso(F.floor(micros / 1000)))
            .when((stamp["key"] == "instant") & nested("epochSecond").isNotNull(), iso(nested("epochSecond") * 1000 + F.floor(F.coalesce(nested("nanoOfSecond"), F.lit(0)) / 1000000)))
            .otherwise(stamp["text"]))
    level = sev.severity_map(F.col("_Level.text"))
    level = F.when(F.col("_Level").isNotNull(), level).otherwise(0)
    fields = (Field("Timestamp", "", "datetime", "timestamp", ""), Field("Level", "", "string", "severityname"), Field("Source", "", "string", "identifier"), Field("Message", "", "string", "message"))
    values = {"Timestamp": time, "Level": F.when(level > 0, sev.display_name(level)).otherwise(F.col("_Level.text")), "Source": F.col("_Source.text"), "Message": F.when(F.col("_Message").isNull(), F.col("raw")).otherwise(F.col("_Message.text"))}
    return events(rows, "jsonlines", fields, values, F.col("_keys").isNotNull(), level, columns=columns).drop("_keys", *[f"_{k}" for k in JSON_KEYS])


def _is_string(key: str) -> Column:
    value = F.try_variant_get(F.try_parse_json(F.when(F.col("_keys").isNotNull(), F.col("raw"))), f"$.{key}", "variant")
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def parse_docker(lines: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Container logs: string ``log``, ``stream`` and ``time``; one line end is cut off the message."""
    rows = _with_keys(lines)
    get = lambda k: F.get_json_object("raw", f"$.{k}")
    fields = (Field("Time", "", "datetime", "timestamp", "iso8601"), Field("Stream", "", "string", "identifier"), Field("Message", "", "string", "message"))
    values = {"Time": get("time"), "Stream": get("stream"), "Message": F.regexp_replace(get("log"), r"(?:\r\n|\n|\r)\z", "")}
    ok = F.col("_keys").isNotNull() & _is_string("log") & _is_string("stream") & _is_string("time")
    return events(rows, "docker", fields, values, ok, columns=columns).drop("_keys")


def parse_gelf(lines: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """GELF: version, host and a string short_message; extra fields as compact JSON with sorted keys."""
    get = lambda k: json_text(F.get_json_object("raw", f"$.{k}"))
    rows = once(_with_keys(lines), [*lines.columns, "_keys"], {"_level": get("level")})
    has = lambda k: F.coalesce(F.array_contains("_keys", k), F.lit(False))
    text = F.col("_level")
    level = F.when(~has("level"), 0).when(sev.number_of(text, "int").isNotNull(), sev.from_priority(text)).otherwise(sev.from_name(text))
    rows = once(rows, rows.columns, {"_severity": level})
    level = F.col("_severity")
    variants = F.from_json(F.when(F.col("_keys").isNotNull(), F.col("raw")), "map<string,variant>")
    wanted = F.map_filter(variants, lambda k, v: (k == "full_message") | (F.startswith(k, F.lit("_")) & (k != "_id")))
    in_order = lambda m: F.map_from_entries(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.struct(k.alias("key"), m[k].alias("value"))))
    extra = let(wanted, lambda m: F.when(F.size(m) > 0, F.to_json(in_order(m))).otherwise(""))
    fields = (Field("Timestamp", "", "datetime", "timestamp", "epoch-s"), Field("Level", "", "string", "severityname"), Field("Host", "", "string", "identifier"), Field("Message", "", "string", "message"), Field("Extra"))
    values = {"Timestamp": get("timestamp"), "Level": F.when(level > 0, sev.display_name(level)).otherwise(text), "Host": get("host"), "Message": F.get_json_object("raw", "$.short_message"), "Extra": extra}
    return events(rows, "gelf", fields, values, has("version") & has("host") & _is_string("short_message"), level, columns=columns).drop("_keys", "_level", "_severity")


def unique_names(names: Column) -> Column:
    """Column names of a header: empty ones numbered, repeated ones (case apart) told apart."""
    def add(done: Column, i: Column) -> Column:
        name = F.when(names[i] == "", F.concat(F.lit("Column "), (i + 1).cast("string"))).otherwise(names[i])
        free = lambda n: ~F.exists(done, lambda x: F.lower(x) == F.lower(n))
        tries = lambda n: F.concat(F.array(n), F.transform(F.sequence(F.lit(2), F.size(names) + 1), lambda k: F.concat(n, F.lit(" ("), k.cast("string"), F.lit(")"))))
        return F.concat(done, F.slice(F.filter(let(name, tries), free), 1, 1))

    return F.when(F.size(names) > 0, F.aggregate(F.sequence(F.lit(0), F.size(names) - 1), F.array().cast("array<string>"), add))


def csv_fields(raw: Column) -> Column:
    """The fields of one CSV record: quoted ones unescaped (text after the closing quote stays), others trimmed."""
    tokens = F.regexp_extract_all(F.concat(raw, F.lit(",")), F.lit(r'(?d)(\s*"(?:[^"]|"")*(?:"[^,]*,|$)|[^,]*,)'), F.lit(1))
    body = lambda t: F.regexp_replace(t, ",$", "")
    quoted = lambda t: F.rlike(t, F.lit(r'^\s*"'))
    inner = lambda t: F.concat(F.replace(F.regexp_extract(t, r'(?s)^\s*"((?:[^"]|"")*)', 1), F.lit('""'), F.lit('"')), F.regexp_extract(t, r'(?s)^\s*"(?:[^"]|"")*"(.*)$', 1))
    return F.transform(tokens, lambda t: F.when(quoted(t), inner(body(t))).otherwise(F.trim(body(t))))


#: Records that tell a CSV column's type, lines among which a W3C file declares its fields.
CSV_RECORDS, W3C_LINES = 64, 32


def csv_headers(lines: DataFrame) -> DataFrame:
    """Per file ``names`` and ``kinds`` (types) of its columns, from its header and first records."""
    near = lines.filter((F.col("line_no") <= CSV_RECORDS) & F.col("raw").isNotNull()).select("file_id", "line_no", csv_fields(F.col("raw")).alias("f"))
    files = near.groupBy("file_id").agg(F.max(F.when(F.col("line_no") == 0, F.col("f"))).alias("head"), F.collect_list(F.when(F.col("line_no") > 0, F.col("f"))).alias("records"))
    integer = lambda v: F.rlike(v, F.lit(r"^[+-]?[0-9]+$")) & v.try_cast("bigint").isNotNull()
    values = lambda i: F.filter(F.transform("records", lambda r: F.get(r, i)), lambda v: v.isNotNull() & (v != ""))
    kinds = F.transform("names", lambda _, i: let(values(i), lambda v: F.when((F.size(v) > 0) & F.forall(v, integer), "integer").otherwise("string")))
    return files.filter((F.size("head") > 1) | (F.get("head", F.lit(0)) != "")).select("file_id", unique_names(F.col("head")).alias("names"), "records").select("file_id", "names", kinds.alias("kinds"))


def table_columns(headers: DataFrame) -> list[tuple[str, bool]]:
    """(name, whether it is an integer in all files) of the columns of all files, by place, then name.

    What comes to the driver are the columns of the result, not the files. Names that differ in case are one column.
    """
    each = headers.select(F.posexplode(F.arrays_zip("names", "kinds")).alias("at", "c")).select("at", F.col("c.names").alias("name"), (F.col("c.kinds") == "integer").alias("whole"))
    found = each.groupBy(F.lower("name").alias("key")).agg(F.min("at").alias("at"), F.min("name").alias("name"), F.every("whole").alias("whole"))
    return [(r["name"], r["whole"]) for r in found.orderBy("at", "name").collect()]


def csv_fields_of(columns: Sequence[tuple[str, bool]]) -> list[Field]:
    message = next((i for i, (n, _) in enumerate(columns) if n.lower() == "message"), len(columns) - 1)
    return [Field(n, "", "integer" if whole else "string", "message" if i == message else "numeric" if whole else "") for i, (n, whole) in enumerate(columns)]


def parse_csv(lines: DataFrame) -> DataFrame:
    """Records of one line, by the header of their own file; columns that a file lacks are empty.

    Extra fields fold into a file's last column; ok where the count is the header's. A file without a header
    gives no values and is not ok; a table without any raises ValueError.
    """
    headers = csv_headers(lines)
    fields = csv_fields_of(table_columns(headers))
    if not fields:
        raise ValueError("no CSV header")
    own = headers.select("file_id", F.transform("names", F.lower).alias("_names"))
    rows = once(lines.join(own, "file_id", "left"), [*lines.columns, "_names"], {"_f": csv_fields(F.col("raw"))})
    n = F.size("_names")
    last = F.concat_ws(",", F.slice("_f", n, F.greatest(F.size("_f") - n + 1, F.lit(0))))

    def value(name: str) -> Column:
        return let(F.array_position("_names", F.lit(name.lower())).cast("int"), lambda at: F.when((at > 0) & (at == n), last).when(at > 0, F.get("_f", at - 1)))

    out = events(rows, "csv", fields, {f.name: value(f.name) for f in fields}, F.size("_f") > 0)
    return out.withColumn("ok", F.coalesce(F.size("_f") == F.size("_names"), F.lit(False))).drop("_f", "_names")


def w3c_headers(lines: DataFrame) -> DataFrame:
    """Per file with a ``#Fields:`` directive before its data: ``tokens``, its lower-case names, and ``names``, those of
    the columns (``date time`` merged to Time)."""
    near = lines.filter(F.col("line_no") < W3C_LINES).select("file_id", "line_no", F.trim("raw").alias("t"))
    data, declared = (F.col("t") != "") & ~F.startswith("t", F.lit("#")), F.startswith(F.lower("t"), F.lit("#fields:"))
    first = near.groupBy("file_id").agg(F.min(F.when(data, F.col("line_no"))).alias("data"), F.min(F.when(declared, F.struct("line_no", "t"))).alias("d"))
    first = first.filter(F.col("d").isNotNull() & (F.col("data").isNull() | (F.col("d.line_no") < F.col("data"))))
    tokens = first.select("file_id", F.filter(F.split(F.substring(F.col("d.t"), F.lit(9), F.length("d.t")), r"\s+"), lambda x: x != "").alias("own")).filter(F.size("own") >= 2)
    tokens = tokens.withColumn("tokens", F.transform("own", F.lower)).withColumn("date", date_place(F.col("tokens")))
    shown = F.when(F.col("date").isNull(), F.col("own")).otherwise(F.concat(F.slice("own", F.lit(1), F.col("date")), F.array(F.lit("Time")), F.slice("own", F.col("date") + 3, F.size("own"))))
    return tokens.select("file_id", "tokens", unique_names(shown).alias("names"))


def date_place(tokens: Column) -> Column:
    """Index of the first ``date`` that ``time`` follows; else null."""
    at = F.filter(F.sequence(F.lit(0), F.size(tokens) - 2), lambda i: (tokens[i] == "date") & (tokens[i + 1] == "time"))
    return F.get(at, F.lit(0))


def w3c_fields_of(names: Sequence[str]) -> list[Field]:
    lower = [n.lower() for n in names]
    last = len(names) - 1 - (lower[-1] == "time" and len(names) > 1) if names else 0
    message = next((lower.index(k) for k in ("cs-uri-stem", "cs-uri") if k in lower), last)
    kind = lambda k: "datetime" if k == "time" else "integer" if k in W3C_INTEGERS else "string"
    hint = lambda i, k: "message" if i == message else "timestamp" if k == "time" else "numeric" if k in W3C_INTEGERS else "identifier" if k in W3C_IDENTIFIERS else ""
    return [Field(n, "", kind(k), hint(i, k), "iso8601" if k == "time" else "") for i, (n, k) in enumerate(zip(names, lower, strict=True))]


def parse_w3c(lines: DataFrame) -> DataFrame:
    """W3C extended logs: white-space tokens by the directive of their own file, ``date time`` merged, overflow in the
    last column; columns that a file lacks are empty. Files without a directive are not ok; a table without any
    raises ValueError."""
    headers = w3c_headers(lines)
    fields = w3c_fields_of([n for n, _ in table_columns(headers.withColumn("kinds", F.transform("names", lambda _: F.lit(""))))])
    if not fields:
        raise ValueError("no #Fields directive")
    own = headers.select("file_id", F.size("tokens").alias("_n"), F.transform("names", F.lower).alias("_names"), date_place(F.col("tokens")).alias("_date"))
    rows = once(lines.join(own, "file_id", "left"), [*lines.columns, "_n", "_names", "_date"], {"_t": F.split(F.trim(F.regexp_replace("raw", r"\s+", " ")), " ")})
    date = F.coalesce("_date", F.lit(-1))

    def value(name: str) -> Column:
        def at_place(at: Column) -> Column:
            first = F.when((date < 0) | (at <= date), at).otherwise(at + 1)  # the token it starts with
            width = F.when(at == date, 2).otherwise(1)
            end = F.when(at == F.size("_names") - 1, F.size("_t")).otherwise(first + width)
            return F.when(at >= 0, F.concat_ws(" ", F.slice("_t", first + 1, F.greatest(end - first, F.lit(0)))))

        return let(F.array_position("_names", F.lit(name.lower())).cast("int") - 1, at_place)

    data = (F.trim("raw") != "") & ~F.startswith(F.ltrim("raw"), F.lit("#")) & F.col("_n").isNotNull()
    out = events(rows, "w3c", fields, {f.name: value(f.name) for f in fields}, data)
    return out.withColumn("ok", F.col("ok") & (F.size("_t") == F.col("_n"))).drop("_t", "_n", "_names", "_date")


def netlog_constants(lines: DataFrame) -> DataFrame:
    """One row: the id-to-name maps, phases and tick offset of a capture's first line, repaired if cut off."""
    text = F.regexp_replace(F.trim("raw"), ",$", "")
    whole = F.when(F.try_parse_json(text).isNotNull(), text).otherwise(F.concat(text, F.lit("}")))
    schema = "struct<constants:struct<logEventTypes:map<string,int>,logSourceType:map<string,int>,logEventPhase:map<string,int>,timeTickOffset:string>>"
    invert = lambda c: F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))
    c = F.from_json(whole, schema)["constants"]
    first = lines.filter((F.col("line_no") == 0) & (F.octet_length("raw") <= 8 << 20))
    return first.select("file_id", invert(c["logEventTypes"]).alias("_types"), invert(c["logSourceType"]).alias("_sources"), F.coalesce(c["logEventPhase"]["PHASE_BEGIN"], F.lit(1)).alias("_begin"), F.coalesce(c["logEventPhase"]["PHASE_END"], F.lit(2)).alias("_end"), c["timeTickOffset"].try_cast("bigint").alias("_tick"))


def parse_netlog(lines: DataFrame) -> DataFrame:
    """Browser network captures: ids by the constants of the file's first line (a row per file joins)."""
    body = F.regexp_replace(F.trim("raw"), r"(,|\]\s*,?\s*\}?)$", "")
    body = F.when(F.try_parse_json(F.regexp_replace(F.trim("raw"), ",$", "")).isNotNull(), F.regexp_replace(F.trim("raw"), ",$", "")).otherwise(body)
    schema = "struct<type:int,time:string,phase:int,source:struct<type:int,id:bigint>>"
    rows = lines.join(netlog_constants(lines), "file_id", "left").withColumn("_body", body).withColumn("_e", F.from_json("_body", schema))
    e = F.col("_e")
    name = lambda table, key: F.coalesce(F.col(table)[key], key.cast("string"))
    ms = F.col("_tick") + e["time"].try_cast("bigint")
    params = F.get_json_object("_body", "$.params")
    fields = (Field("Time", "", "datetime", "timestamp", "iso8601"), Field("Source", "", "string", "identifier"), Field("Phase"), Field("Event", "", "string", "identifier"), Field("Params", "", "string", "message"))
    values = {
        "Time": F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "Source": F.concat_ws(" ", name("_sources", e["source"]["type"]), e["source"]["id"].cast("string")),
        "Phase": F.when(e["phase"] == F.col("_begin"), "+").when(e["phase"] == F.col("_end"), "-").otherwise(""),
        "Event": name("_types", e["type"]), "Params": F.when(F.startswith(params, F.lit("{")), F.to_json(F.try_parse_json(params))).otherwise(""),
    }
    out = events(rows, "netlog", fields, values, e["type"].isNotNull() & e["source"].isNotNull())
    return out.drop("_types", "_sources", "_begin", "_end", "_tick", "_body", "_e")


def extract_columns(parsed: DataFrame, *columns: str, with_severity: bool = False) -> DataFrame:
    """Key columns and the wanted ones of parsed rows; of a kept extraction nothing else is read."""
    return parsed.select("file_id", "line_no", *(["severity"] if with_severity else []), *[f"`{c}`" for c in columns])


def extract(lines: DataFrame, fmt: str, *columns: str, with_severity: bool = False, **options) -> DataFrame:
    """``extract_columns`` of raw lines; what nothing wants is not computed."""
    wanted = [*columns, *(["severity"] if with_severity else [])]
    return extract_columns(parse(lines, fmt, columns=wanted, **options), *columns, with_severity=with_severity)


def data_lines_only(lines: DataFrame, fmt: str) -> DataFrame:
    """Without a CSV header, ``#`` directives or a capture's wrapper lines."""
    wrapper = F.rlike("raw", F.lit(r'^\s*(\{"constants"|"events"\s*:|\]|\})'))
    meta = {"csv": F.col("line_no") == 0, "w3c": F.startswith(F.ltrim("raw"), F.lit("#")) | (F.trim("raw") == ""), "netlog": (F.col("line_no") == 0) | wrapper}.get(fmt)
    return lines if meta is None else lines.filter(~meta)


PARSERS = {
    "plaintext": parse_plaintext, "logcat": parse_logcat, "clf": parse_clf, "csv": parse_csv, "jsonlines": parse_jsonlines,
    "docker": parse_docker, "gelf": parse_gelf, "w3c": parse_w3c, "netlog": parse_netlog,
}


#: Jobs that take their columns from the files' headers; they make all of them.
BY_HEADER = ("csv", "w3c", "netlog")


def parse(lines: DataFrame, fmt: str, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Run the job of a format by name. With ``columns``, only those of its columns are made, and none runs no pattern."""
    if columns is not None and not columns:
        return lines
    if columns is not None and fmt not in BY_HEADER:
        options["columns"] = columns
    return PARSERS[fmt](lines, **options) if fmt in PARSERS else parse_spec(lines, builtin_spec(fmt), **options)
