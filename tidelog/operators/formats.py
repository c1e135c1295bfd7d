"""The declared formats: line pattern, fields and severity of each."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Field:
    name: str
    capture: str = ""
    type: str = "string"
    hint: str = ""
    time_format: str = ""


# Patterns, field names, time formats and severity names of the formats.
SPECS: dict[str, dict] = {
    "alternatives": {
        "pattern": r"^update-alternatives (?<time>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}): (?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "iso8601"),
            Field("Message", "msg", "string", "message"),
        ],
        "specificity": 0.9,
    },
    "apache-error": {
        "pattern": r"^\[[A-Z][a-z]{2} (?<time>[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}(?:\.\d{1,3})?)\d* (\d{4})\] \[(?:(?<module>[\w.-]+):)?(?<level>[a-z]+\d*)\] (?:\[pid (?<pid>\d+)(?::tid (?<tid>\d+))?\] )?(?:\[client (?<client>[^\]]+)\] )?(?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "MMM d HH:mm:ss"),
            Field("Module", "module", "string", "identifier"),
            Field("Level", "level", "string", "severityname"),
            Field("PID", "pid", "integer", "numeric"),
            Field("TID", "tid", "integer", "numeric"),
            Field("Client", "client", "string", "identifier"),
            Field("Message", "msg", "string", "message"),
        ],
        "severity": ("level", {"emerg": "fatal", "alert": "fatal", "crit": "fatal", "error": "error", "warn": "warning", "notice": "info", "info": "info", "debug": "debug", "trace1": "verbose", "trace2": "verbose", "trace3": "verbose", "trace4": "verbose", "trace5": "verbose", "trace6": "verbose", "trace7": "verbose", "trace8": "verbose"}, "none"),
        "specificity": 0.95,
    },
    "apport": {
        "pattern": r"^(?<level>[A-Z]+): apport \(pid (?<pid>\d+)\) (?<time>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}): (?<msg>.*)$",
        "fields": [
            Field("Level", "level", "string", "severityname"),
            Field("PID", "pid", "integer", "numeric"),
            Field("Time", "time", "datetime", "timestamp", "iso8601"),
            Field("Message", "msg", "string", "message"),
        ],
        "severity": ("level", {"info": "info", "warning": "warning", "error": "error"}, "none"),
        "specificity": 0.9,
    },
    "apt-history": {
        "pattern": r"^(?<key>Start-Date|End-Date|Commandline|Requested-By|Install|Upgrade|Remove|Purge|Downgrade|Reinstall|Error): (?<value>.*)$",
        "fields": [
            Field("Key", "key", "string", "identifier"),
            Field("Value", "value", "string", "message"),
        ],
        "severity": ("key", {"error": "error"}, "none"),
        "specificity": 0.9,
    },
    "apt-term": {
        "pattern": r"^(?<action>Log started|Log ended|Preparing to unpack|Unpacking|Setting up|Processing triggers for|Selecting previously unselected package|De-configuring|Removing|Purging configuration files for):? (?<detail>.*)$",
        "fields": [
            Field("Action", "action", "string", "identifier"),
            Field("Details", "detail", "string", "message"),
        ],
        "specificity": 0.8,
    },
    "audit": {
        "pattern": r"^(?:node=(?<node>\S+) )?type=(?<type>\S+) msg=audit\((?<time>\d+\.\d+):(?<serial>\d+)\): ?(?<msg>.*)$",
        "fields": [
            Field("Node", "node", "string", "identifier"),
            Field("Type", "type", "string", "identifier"),
            Field("Time", "time", "datetime", "timestamp", "epoch-s"),
            Field("Serial", "serial", "integer", "numeric"),
            Field("Message", "msg", "string", "message"),
        ],
        "specificity": 0.95,
    },
    "cef": {
        "pattern": r"^(?:(?<time>[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+-]\d{2}:?\d{2})?) (?<host>\S+) (?:(?<proc>\S+?(?:\[\d+\])?): )?)?CEF:(?<cefver>\d+)\|(?<vendor>(?:\\.|[^|\\])*)\|(?<product>(?:\\.|[^|\\])*)\|(?<pver>(?:\\.|[^|\\])*)\|(?<sig>(?:\\.|[^|\\])*)\|(?<name>(?:\\.|[^|\\])*)\|(?<sev>[^|]*)\|(?<ext>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp"),
            Field("Host", "host", "string", "identifier"),
            Field("CEF Version", "cefver", "integer"),
            Field("Vendor", "vendor", "string", "identifier"),
            Field("Product", "product", "string", "identifier"),
            Field("Product Version", "pver", "string"),
            Field("Signature ID", "sig", "string", "identifier"),
            Field("Name", "name", "string"),
            Field("Severity", "sev", "string", "severityname"),
            Field("Extensions", "ext", "string", "message"),
        ],
        "severity": ("sev", {"0": "info", "1": "info", "2": "info", "3": "info", "4": "warning", "5": "warning", "6": "warning", "7": "error", "8": "error", "9": "fatal", "10": "fatal", "low": "info", "medium": "warning", "high": "error", "very-high": "fatal", "very high": "fatal", "unknown": "none"}, "none"),
        "specificity": 0.95,
    },
    "cloud-init-output": {
        "pattern": r"^(?:(?<time>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (?<module>\S+)\[(?<level>[A-Z]+)\]: |(?=Cloud-init v\. ))(?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "iso8601"),
            Field("Module", "module", "string", "identifier"),
            Field("Level", "level", "string", "severityname"),
            Field("Message", "msg", "string", "message"),
        ],
        "severity": ("level", {"debug": "debug", "info": "info", "warning": "warning", "error": "error", "critical": "fatal"}, "none"),
        "specificity": 0.85,
    },
    "cloud-init": {
        "pattern": r"^(?<time>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - (?<module>\S+)\[(?<level>[A-Z]+)\]: (?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "iso8601"),
            Field("Module", "module", "string", "identifier"),
            Field("Level", "level", "string", "severityname"),
            Field("Message", "msg", "string", "message"),
        ],
        "severity": ("level", {"debug": "debug", "info": "info", "warning": "warning", "error": "error", "critical": "fatal"}, "none"),
        "specificity": 0.9,
    },
    "cri": {
        "pattern": r"^(?<time>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})) (?<stream>stdout|stderr) (?<tag>[FP]) ?(?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "iso8601"),
            Field("Stream", "stream", "string", "identifier"),
            Field("Tag", "tag", "string"),
            Field("Message", "msg", "string", "message"),
        ],
        "specificity": 0.95,
    },
    "dmesg": {
        "pattern": r"^\[\s*(?<time>\d+\.\d+)\]\s(?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "uptime"),
            Field("Message", "msg", "string", "message"),
        ],
        "specificity": 0.9,
    },
    "dpkg": {
        "pattern": r"^(?<time>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) (?<action>startup|status|configure|install|upgrade|remove|purge|trigproc|conffile) (?<detail>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "iso8601"),
            Field("Action", "action", "string", "identifier"),
            Field("Details", "detail", "string", "message"),
        ],
        "specificity": 0.9,
    },
    "keyvalue": {
        "pattern": r"""^ts=(?<ts>\S+) level=(?<level>\S+)(?: code=(?<code>\d+))? msg="?(?<msg>[^"]*)"?""",
        "fields": [
            Field("Timestamp", "ts", "datetime", "timestamp", "iso8601"),
            Field("Level", "level", "string", "severityname"),
            Field("Code", "code", "integer", "numeric"),
            Field("Message", "msg", "string", "message"),
        ],
        "severity": ("level", {"trace": "verbose", "debug": "debug", "info": "info", "warn": "warning", "warning": "warning", "error": "error", "fatal": "fatal", "panic": "fatal"}, "none"),
        "specificity": 0.9,
    },
    "klog": {
        "pattern": r"^(?<level>[IWEF])(?<time>\d{4} \d{2}:\d{2}:\d{2}\.\d{6})\s+(?<tid>\d+) (?<loc>[^ \]]+)\] ?(?<msg>.*)$",
        "fields": [
            Field("Level", "level", "string", "severityname"),
            Field("Time", "time", "datetime", "timestamp", "MMdd HH:mm:ss.zzzzzz"),
            Field("Thread", "tid", "integer", "numeric"),
            Field("Location", "loc", "string", "identifier"),
            Field("Message", "msg", "string", "message"),
        ],
        "severity": ("level", {"i": "info", "w": "warning", "e": "error", "f": "fatal"}, "none"),
        "specificity": 0.9,
    },
    "leef": {
        "pattern": r"^(?:(?<time>[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T[\d:.]+(?:Z|[+-]\d{2}:?\d{2})?) (?<host>\S+) (?:(?<proc>\S+?(?:\[\d+\])?): )?)?LEEF:(?<leefver>\d+(?:\.\d+)?)\|(?<vendor>[^|]*)\|(?<product>[^|]*)\|(?<pver>[^|]*)\|(?<event>[^|]*)\|(?:(?<delim>[^=|]{0,4})\|)?(?<ext>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp"),
            Field("Host", "host", "string", "identifier"),
            Field("LEEF Version", "leefver", "string"),
            Field("Vendor", "vendor", "string", "identifier"),
            Field("Product", "product", "string", "identifier"),
            Field("Product Version", "pver", "string"),
            Field("Event ID", "event", "string", "identifier"),
            Field("Delimiter", "delim", "string"),
            Field("Extensions", "ext", "string", "message"),
        ],
        "specificity": 0.95,
    },
    "logback": {
        "pattern": r"^(?<time>\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}[.,]\d{3}) +\[(?<thread>[^\]]*)\] +(?<level>TRACE|DEBUG|INFO|WARN|ERROR|FATAL) +(?<logger>\S+) +-+ ?(?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "iso8601"),
            Field("Thread", "thread", "string", "identifier"),
            Field("Level", "level", "string", "severityname"),
            Field("Logger", "logger", "string", "identifier"),
            Field("Message", "msg", "string", "message"),
        ],
        "severity": ("level", {"trace": "verbose", "debug": "debug", "info": "info", "warn": "warning", "error": "error", "fatal": "fatal"}, "none"),
        "specificity": 0.9,
    },
    "nagios": {
        "pattern": r"^\[(?<time>\d{9,11})\] (?:(?<type>[A-Z][A-Z _/-]*[A-Z]): )?(?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "epoch-s"),
            Field("Type", "type", "string", "identifier"),
            Field("Message", "msg", "string", "message"),
        ],
        "specificity": 0.9,
    },
    "nginx-error": {
        "pattern": r"^(?<time>\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(?<level>[a-z]+)\] (?<pid>\d+)#(?<tid>\d+): (?:\*(?<conn>\d+) )?(?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "yyyy/MM/dd HH:mm:ss"),
            Field("Level", "level", "string", "severityname"),
            Field("PID", "pid", "integer", "numeric"),
            Field("TID", "tid", "integer", "numeric"),
            Field("Connection", "conn", "integer", "numeric"),
            Field("Message", "msg", "string", "message"),
        ],
        "severity": ("level", {"emerg": "fatal", "alert": "fatal", "crit": "fatal", "error": "error", "warn": "warning", "notice": "info", "info": "info", "debug": "debug"}, "none"),
        "specificity": 0.95,
    },
    "s3-access": {
        "pattern": r"""^(?<owner>\S+) (?<bucket>\S+) \[(?<time>\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\] (?<ip>\S+) (?<requester>\S+) (?<reqid>\S+) (?<operation>\S+) (?<key>\S+) (?:"(?<request>[^"]*)"|-) (?<status>\d{3}|-) (?<errcode>\S+) (?<bytes>\d+|-) (?<objsize>\d+|-) (?<totaltime>\d+|-) (?<turnaround>\d+|-) (?:"(?<referrer>[^"]*)"|-) (?:"(?<agent>[^"]*)"|-) (?<versionid>\S+)(?: (?<extra>.*))?$""",
        "fields": [
            Field("Bucket Owner", "owner", "string", "identifier"),
            Field("Bucket", "bucket", "string", "identifier"),
            Field("Time", "time", "datetime", "timestamp", "dd/MMM/yyyy:HH:mm:ss"),
            Field("Remote IP", "ip", "string", "identifier"),
            Field("Requester", "requester", "string", "identifier"),
            Field("Request ID", "reqid", "string", "identifier"),
            Field("Operation", "operation", "string", "identifier"),
            Field("Key", "key", "string"),
            Field("Request-URI", "request", "string", "message"),
            Field("Status", "status", "integer", "numeric"),
            Field("Error Code", "errcode", "string"),
            Field("Bytes Sent", "bytes", "integer", "numeric"),
            Field("Object Size", "objsize", "integer", "numeric"),
            Field("Total Time", "totaltime", "integer", "numeric"),
            Field("Turn-Around Time", "turnaround", "integer", "numeric"),
            Field("Referrer", "referrer", "string"),
            Field("User-Agent", "agent", "string"),
            Field("Version ID", "versionid", "string"),
            Field("Extra", "extra", "string"),
        ],
        "specificity": 0.95,
    },
    "snort": {
        "pattern": r"^(?<time>\d{2}/\d{2}-\d{2}:\d{2}:\d{2}\.\d{6})\s+\[\*\*\]\s+\[(?<sig>[\d:]+)\]\s+(?<msg>.*?)\s+\[\*\*\]\s+(?:\[Classification:\s+(?<class>[^\]]+)\]\s+)?\[Priority:\s+(?<priority>\d+)\]\s+\{(?<proto>\w+)\}\s+(?<src>\S+)\s+->\s+(?<dst>\S+)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "MM/dd-HH:mm:ss.zzzzzz"),
            Field("Signature", "sig", "string", "identifier"),
            Field("Message", "msg", "string", "message"),
            Field("Classification", "class", "string"),
            Field("Priority", "priority", "string", "severityname"),
            Field("Protocol", "proto", "string", "identifier"),
            Field("Source", "src", "string", "identifier"),
            Field("Destination", "dst", "string", "identifier"),
        ],
        "severity": ("priority", {"1": "error", "2": "warning", "3": "info", "4": "verbose"}, "none"),
        "specificity": 0.95,
    },
    "sysdig": {
        "pattern": r"^(?<num>\d+) (?<time>\d{2}:\d{2}:\d{2}\.\d{6,9}|\d{9,11}\.\d{6,9}) (?<cpu>\d+) (?<proc>.+?) \((?<tid>\d+)\) (?<dir>[<>]) (?<type>\S+)(?: (?<info>.*))?$",
        "fields": [
            Field("Event #", "num", "integer", "numeric"),
            Field("Time", "time", "datetime", "timestamp"),
            Field("CPU", "cpu", "integer", "numeric"),
            Field("Process", "proc", "string", "identifier"),
            Field("TID", "tid", "integer", "numeric"),
            Field("Dir", "dir", "string"),
            Field("Type", "type", "string", "identifier"),
            Field("Info", "info", "string", "message"),
        ],
        "specificity": 0.9,
    },
    "syslog-iso": {
        "pattern": r"^(?<time>\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[+-]\d{2}:\d{2}|Z)?) (?<host>\S+) (?<proc>[^\[:]+)?(?:\[(?<pid>\d+)\])?: ?(?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "iso8601"),
            Field("Host", "host", "string", "identifier"),
            Field("Process", "proc", "string", "identifier"),
            Field("PID", "pid", "integer", "numeric"),
            Field("Message", "msg", "string", "message"),
        ],
        "specificity": 0.9,
    },
    "syslog-rfc3164": {
        "pattern": r"^(?<time>[A-Z][a-z]{2}\s+\d{1,2} \d{2}:\d{2}:\d{2}) (?<host>\S+) (?<proc>[^\[:]+)?(?:\[(?<pid>\d+)\])?: ?(?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "MMM d HH:mm:ss"),
            Field("Host", "host", "string", "identifier"),
            Field("Process", "proc", "string", "identifier"),
            Field("PID", "pid", "integer", "numeric"),
            Field("Message", "msg", "string", "message"),
        ],
        "specificity": 0.85,
    },
    "xorg": {
        "pattern": r"^\[ *(?<time>\d+\.\d{3})\] (?:\((?<marker>--|\*\*|==|\+\+|!!|II|WW|EE|NI|\?\?)\) )?(?<msg>.*)$",
        "fields": [
            Field("Time", "time", "datetime", "timestamp", "uptime"),
            Field("Marker", "marker", "string", "identifier"),
            Field("Message", "msg", "string", "message"),
        ],
        "severity": ("marker", {"ii": "info", "ww": "warning", "ee": "error", "ni": "warning"}, "none"),
        "specificity": 0.95,
    },
}
