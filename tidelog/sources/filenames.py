"""Names of an engine's files: {number}.{suffix}, and a few fixed names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.schema import InvalidArgument

#: Suffixes and names, and the kind of file each stands for.
SUFFIXES = {"log": "wal", "sst": "table", "blob": "blob", "dbtmp": "temp"}
NUMBERED = {"MANIFEST-": "descriptor", "OPTIONS-": "options"}
PLAIN = {"CURRENT": "current", "LOCK": "lock", "IDENTITY": "identity", "LOG": "info_log"}
OLD_LOG = "LOG.old."


def make(kind: str, number: int = 0) -> str:
    for table, shape in ((SUFFIXES, "{n:06}.{name}"), (NUMBERED, "{name}{n:06}"), (PLAIN, "{name}")):
        for name, k in table.items():
            if k == kind:
                return shape.format(n=number, name=name)
    raise InvalidArgument(f"no file is of kind {kind!r}")


def parse(name: str) -> tuple[str, int]:
    """Kind and number (0 where the name has none)."""
    if name in PLAIN:
        return PLAIN[name], 0
    if name.startswith(OLD_LOG) and name[len(OLD_LOG) :].isdecimal():
        return "info_log", 0
    for head, kind in NUMBERED.items():
        if name.startswith(head) and name[len(head) :].isdecimal():
            return kind, int(name[len(head) :])
    number, _, suffix = name.partition(".")
    if number.isdecimal() and suffix in SUFFIXES:
        return SUFFIXES[suffix], int(number)
    raise InvalidArgument(f"not a name of one of the engine's files: {name!r}")


def parsed(name: Column) -> tuple[Column, Column]:
    """Kind and number of a column of names, in the JVM; null where a name is none of the engine's."""
    pairs = [item for k, v in SUFFIXES.items() for item in (F.lit(k), F.lit(v))]
    suffix = F.regexp_extract(name, r"^[0-9]+\.([a-z]+)$", 1)
    headed = F.regexp_extract(name, r"^(MANIFEST-|OPTIONS-)[0-9]+$", 1)
    kind = F.when(name.rlike(r"^LOG\.old\.[0-9]+$"), "info_log")
    for plain, k in PLAIN.items():
        kind = kind.when(name == plain, k)
    for head, k in NUMBERED.items():
        kind = kind.when(headed == head, k)
    kind = kind.otherwise(F.create_map(*pairs)[suffix])
    number = F.coalesce(
        F.regexp_extract(name, r"^([0-9]+)\.[a-z]+$", 1).try_cast("long"), F.regexp_extract(name, r"^(?:MANIFEST-|OPTIONS-)([0-9]+)$", 1).try_cast("long"), F.lit(0)
    )
    return kind, F.when(kind.isNotNull(), number)
