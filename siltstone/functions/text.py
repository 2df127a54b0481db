"""Paths, names, URLs, globs, dates and literals as column functions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from email.utils import format_datetime, parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.binary import joined, netstring

WORD = "[\\p{L}\\p{M}\\p{N}\\p{Pc}]+"  #: what \w means for names: Unicode letters, marks, digits and connectors


def split_path(path: Column | str) -> Column:
    """Components of a path given as text; the empty path has none."""
    path = F.col(path) if isinstance(path, str) else path
    return F.filter(F.split(path, "/"), lambda x: x != "")


def join_path(parts: Column | str) -> Column:
    return F.array_join(parts, "/")


def path_depth(parts: Column | str) -> Column:
    return F.size(parts)


def push_front(parts: Column | str, name: Column) -> Column:
    return F.array_prepend(parts, name)


def push_back(parts: Column | str, name: Column) -> Column:
    return F.array_append(parts, name)


def with_base(base: Column | str, parts: Column | str) -> Column:
    return F.concat(base, parts)


def encode_path(parts: Column | str) -> Column:
    """Netstrings of the components, side by side."""
    return joined(F.transform(parts, netstring))


def guarded(parts: Column | str) -> Column:
    """The path, or an error if a component is ``.`` or ``..``."""
    parts = F.col(parts) if isinstance(parts, str) else parts
    bad = F.exists(parts, lambda x: x.isin(".", ".."))
    return F.when(~bad, parts).otherwise(F.raise_error(F.concat(F.lit("a path leaves its root: "), join_path(parts))).cast("array<string>"))


def strip_base(parts: Column, base: list[str]) -> Column:
    """The path below ``base``; an error if it does not lie there."""
    n = len(base)
    below = F.slice(parts, F.lit(1), F.lit(n)) == F.array(*map(F.lit, base)).cast("array<string>") if n else F.lit(True)
    return F.when(below, F.slice(parts, F.lit(n + 1), F.size(parts))).otherwise(F.raise_error(F.lit("a path lies outside of the repository")).cast("array<string>"))


def is_name(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return text.rlike(f"^{WORD}$")


def parse_ref(text: Column | str) -> Column:
    """STRUCT<kind, remote, branch>: HEAD, then ``branch``, then ``remote/branch``; null if it is none of them."""
    text = F.col(text) if isinstance(text, str) else text
    remote = F.regexp_extract(text, f"^({WORD})/({WORD})$", 1)
    kind = F.when(text == "HEAD", "head").when(is_name(text), "local").when(remote != "", "remote")
    branch = F.when(kind == "local", text).when(kind == "remote", F.regexp_extract(text, f"^({WORD})/({WORD})$", 2))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(kind == "remote", remote).alias("remote"), branch.alias("branch")))


def ref_parts(text: str) -> tuple[str, str | None, str | None]:
    """(kind, remote, branch) of one reference; ValueError if it is none."""
    if text == "HEAD":
        return "head", None, None
    if re.fullmatch(r"\w+", text):
        return "local", None, text
    if m := re.fullmatch(r"(\w+)/(\w+)", text):
        return "remote", m[1], m[2]
    raise ValueError(f"not a reference: {text!r}")


def url_parts(url: Column | str) -> Column:
    """STRUCT<scheme, host, path> of a URL."""
    url = F.col(url) if isinstance(url, str) else url
    return F.struct(F.parse_url(url, F.lit("PROTOCOL")).alias("scheme"), F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("PATH")).alias("path"))


def glob_regex(glob: str) -> str:
    """A regular expression for a path glob: ``**`` crosses directories, ``*`` and ``?`` do not, ``[...]`` and ``{a,b}`` choose."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] == "!" else body) + "]", end + 1
            continue
        depth += (c == "{") - (c == "}" and depth > 0)
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        i += 1
    return f"^{out}$"


def matches_glob(path: Column | str, glob: str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return path.rlike(glob_regex(glob))


def selected(path: Column, added: Column, tracked: Column, include: str | None, exclude: str | None) -> Column:
    """Included, added or tracked, and not excluded."""
    wanted = (matches_glob(path, include) if include else F.lit(False)) | added | tracked
    return wanted & ~(matches_glob(path, exclude) if exclude else F.lit(False))


def rfc2822(seconds: Column | str, offset_s: Column | str) -> Column:
    """A date as in mail headers, from seconds since 1970 and the offset from UTC, with two-digit days."""
    seconds, offset = (F.col(c) if isinstance(c, str) else c for c in (seconds, offset_s))
    local = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(secs=(seconds + offset).cast("decimal(18,6)"))
    minutes = F.abs(offset) / 60
    sign = F.when(offset < 0, "-").otherwise("+")
    zone = F.concat(sign, F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"), F.lpad((minutes % 60).cast("int").cast("string"), 2, "0"))
    return F.concat(F.date_format(local, "EEE, dd MMM yyyy HH:mm:ss "), zone)


def format_rfc2822(seconds: int, offset_s: int) -> str:
    return format_datetime(datetime.fromtimestamp(seconds, timezone(timedelta(seconds=offset_s))))


def parse_rfc2822(text: str) -> tuple[int, int]:
    """Seconds since 1970 and the offset from UTC in seconds."""
    d = parsedate_to_datetime(text)
    return int(d.timestamp()), int(d.utcoffset().total_seconds()) if d.utcoffset() else 0


def escape_literal(text: str) -> str:
    """A literal's bytes with tab, line ends, quotes and backslash escaped, others beyond printable ASCII as \\xNN."""
    named = {9: "\\t", 10: "\\n", 13: "\\r", 34: '\\"', 39: "\\'", 92: "\\\\"}
    return "".join(named.get(b) or (chr(b) if 32 <= b < 127 else f"\\x{b:02x}") for b in text.encode())


def unescape_literal(text: str) -> str:
    out, i = bytearray(), 0
    named = {"t": 9, "n": 10, "r": 13}
    while i < len(text):
        if text[i] != "\\":
            out += text[i].encode()
            i += 1
        elif text[i + 1] == "x":
            out.append(int(text[i + 2 : i + 4], 16))
            i += 4
        else:
            out.append(named.get(text[i + 1], ord(text[i + 1])))
            i += 2
    return out.decode()
