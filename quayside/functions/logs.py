"""Fields of an access-log line in the combined format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pattern of one combined-format line. Groups: 1 address, 2 identity, 3 user,
# 4 time, 5 request, 6 status, 7 bytes, 8 referrer, 9 agent.
ACCESS_LOG_PATTERN = (
    r'^([\d.]+) (\S+) (\S+) \[([\w\d:/]+\s[+\-]\d{4})\] "(.+?)" (\d{3}) ([\d\-]+) "([^"]+)" "([^"]+)"(?s:.*)'
)

_MARK = "\x01"


def access_log_fields(lines: DataFrame, line: str) -> DataFrame:
    """`ip, bytes, usr, request` of each line, all NULL when the line does not match.

    The pattern is applied once per line: the match is rewritten to a marked, space separated form
    in one step and cut in the next. The first three fields hold no space, so a cut into four pieces
    is exact whatever the request contains. A line that already starts with the mark cannot match.
    """
    rewritten = lines.select(F.regexp_replace(F.col(line), ACCESS_LOG_PATTERN, _MARK + "$1 $7 $3 $5").alias("_r"), F.col(line).startswith(_MARK).alias("_m"))
    cut = rewritten.select(F.when(F.col("_r").startswith(_MARK) & ~F.col("_m"), F.split(F.substr("_r", F.lit(2)), " ", 4)).alias("_p"))
    return cut.select(*[F.get("_p", F.lit(i)).alias(name) for i, name in enumerate(("ip", "bytes", "usr", "request"))])
