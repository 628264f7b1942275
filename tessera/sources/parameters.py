"""Parameter files: a line with the length of the rest in bytes, lines of name=value, an empty line.

A word with white space or punctuation stands in double quotes, with \\" \\n \\r \\t \\\\ as escapes; other words stand as they are.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first word of a file, and escapes in quotes.
FIRST = "Param"
ESCAPES = {"\\": "\\", '"': '"', "n": "\n", "r": "\r", "t": "\t"}
SPECIAL = {"name": '"\\s=', "value": '"\\s', "item": '"\\s,\\[\\]{}='}


def quoted(word: str, where: str = "item") -> str:
    if not re.search(f"[{SPECIAL[where]}]", word):
        return word
    back = {v: "\\" + k for k, v in ESCAPES.items()}
    return '"' + "".join(back.get(c, c) for c in word) + '"'


def word_at(text: str, at: int, ends: str) -> tuple[str, int]:
    """A word, quoted or up to one of the characters `ends` (none: the rest), and the place after it."""
    plain = f"[^{re.escape(ends)}]*" if ends else ".*"
    found = re.compile(rf'\s*(?:"(?P<q>(?:\\.|[^"\\])*)"?|(?P<p>{plain}))', re.S).match(text, at)
    if found["q"] is None:
        return found["p"].rstrip(), found.end()
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), found["q"], flags=re.S), found.end()


def parse_list(text: str) -> list[str] | None:
    """`[a, b]`; "[]" is a list of one empty word; None where the form is wrong."""
    opened = re.match(r"\s*\[", text)
    out, at, end = [], opened.end() if opened else len(text), ","
    while end == "," and opened:
        word, at = word_at(text, at, ",]")
        out.append(word)
        end, at = text[at : at + 1], at + 1
    return out if end == "]" else None


def parse_map(text: str) -> dict[str, str] | None:
    """`{a=1, b=2}`; None where the form is wrong."""
    opened = re.match(r"\s*\{", text)
    out, at, end = {}, opened.end() if opened else len(text), ","
    while end == "," and opened:
        name, at = word_at(text, at, "=")
        if text[at : at + 1] != "=":
            return None
        out[name], at = word_at(text, at + 1, ",}")
        end, at = text[at : at + 1], at + 1
    return out if end == "}" else None


def format_list(words: list[str]) -> str:
    return "[" + ",".join(map(quoted, words)) + "]"


def format_map(words: dict[str, str]) -> str:
    return "{" + ",".join(f"{quoted(k)}={quoted(v)}" for k, v in sorted(words.items())) + "}"


def format_float(x: float) -> str:
    return f"{x:.8g}"


def parse_parameters(content: str) -> dict[str, str]:
    """Lines up to the first empty one; lines without a name or an equals sign are passed over."""
    first, _, rest = content.partition("\n")
    if not re.match(FIRST + r" \d+", first):
        raise ValueError("not a parameter file")
    out = {}
    for line in rest.split("\n"):
        if not line:
            break
        name, at = word_at(line, 0, "=")
        if name and line[at : at + 1] == "=":
            out[name] = word_at(line, at + 1, "")[0]
    return out


def format_parameters(values: dict[str, str]) -> str:
    lines = "".join(f"{quoted(k, 'name')}={quoted(v, 'value')}\n" for k, v in sorted(values.items())) + "\n"
    return f"{FIRST} {len(lines.encode())}\n{lines}"


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, value) of each parameter file: one row for each name."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                got = parse_parameters(content.decode("utf-8", "replace"))
                if got:
                    yield pa.RecordBatch.from_pydict({"file": [file] * len(got), "name": list(got), "value": list(got.values())})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, name string, value string")


def write_parameters(df: DataFrame, path: str) -> None:
    """(file, name, value): a text file for the parameters of each `file`, as rows of one text each, in folders file=..."""
    from pyspark.sql import types as ST

    form = F.udf(lambda pairs: format_parameters({p["name"]: p["value"] for p in pairs})[:-1], ST.StringType())  # the writer ends the last line
    made = df.groupBy("file").agg(form(F.collect_list(F.struct("name", "value"))).alias("value"))
    made.write.partitionBy("file").text(path)
