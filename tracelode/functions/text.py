"""Scalar expressions over texts, paths, sizes and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(text: Column, n: int) -> Column:
    """At most n characters, cut at the last space if that is past the middle, with an ellipsis."""
    head = F.substring(text, 1, n)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (space > n // 2), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("...")))


def human_size(n: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal, by 1024."""
    of = lambda unit, name: F.concat(F.format_number(n / unit, 1), F.lit(name))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, of(1 << 10, " KB")).when(n < 1 << 30, of(1 << 20, " MB")).otherwise(of(1 << 30, " GB"))


def relative_time(ts: Column, now: Column) -> Column:
    """How long before `now`, in its largest whole unit."""
    s = F.timestamp_diff("SECOND", ts, now)
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
    whole = lambda d: F.floor(s / d)
    return F.when(s < 60, F.lit("just now")).when(s < 3600, said(whole(60), "minute")).when(s < 86400, said(whole(3600), "hour")).otherwise(said(whole(86400), "day"))


def tag(text: Column) -> Column:
    """Trimmed, in lower case, spaces as hyphens, other signs dropped."""
    return F.regexp_replace(F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("-")), r"[^\p{Alnum}_-]", "")


def normal_error(tool: Column, error: Column) -> Column:
    """An error's first line that says something, without paths, positions and colours, after its tool's name."""
    plain = F.regexp_replace(error, "\u001b\\[[0-9;]*m", "")
    plain = F.regexp_replace(plain, r"(?:/[\w.@-]+){2,}", "<PATH>")
    plain = F.regexp_replace(plain, r":\d+(?::\d+)?", ":<N>")
    first = F.element_at(F.filter(F.split(plain, "\n"), lambda x: F.trim(x) != ""), 1)
    return F.concat(tool, F.lit(": "), F.coalesce(F.substring(F.trim(first), 1, 120), F.lit("")))


def csv_field(text: Column) -> Column:
    """Quoted where RFC 4180 asks for it."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def tool_kind(name: Column) -> Column:
    """The family of a tool's name."""
    groups = {
        "shell": ("bash", "shell", "exec_command", "bashoutput", "killshell"), "file_read": ("read", "notebookread", "ls"), "file_write": ("write", "edit", "multiedit", "notebookedit", "apply_patch"),
        "search": ("grep", "glob"), "web": ("webfetch", "websearch"), "subagent": ("task", "agent"), "orchestration": ("todowrite", "exitplanmode", "skill"),
    }
    low = F.lower(name)
    out = F.when(low.startswith("mcp__") | low.contains("__"), F.lit("mcp"))
    for kind, names in groups.items():
        out = out.when(low.isin(*names), F.lit(kind))
    return out.otherwise(F.concat(F.lit("other:"), low))


#: Of each tool's input, the fields that tell what a call is about, and how much of each is shown (0: all).
TELLING = {
    "Read": (("file_path", 0),), "Write": (("file_path", 0), ("content", 500)), "Edit": (("file_path", 0), ("old_string", 200), ("new_string", 200)), "MultiEdit": (("file_path", 0),),
    "Bash": (("command", 200),), "Grep": (("pattern", 0), ("path", 0)), "Glob": (("pattern", 0),), "Agent": (("description", 100), ("subagent_type", 0), ("prompt", 500)),
    "Task": (("description", 100), ("subagent_type", 0), ("prompt", 500)), "WebSearch": (("query", 150),), "WebFetch": (("url", 0),),
}


def input_summary(tool: Column, given: Column) -> Column:
    """A map of what tells a call apart: the telling fields of its input (JSON text), a list of edits by their number and first, todos in one line; null fields are left out."""
    text = lambda path, n: truncated(F.trim(F.get_json_object(given, path)), n) if n else F.get_json_object(given, path)
    field = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    edits = F.from_json(F.get_json_object(given, "$.edits"), "array<string>")
    todos = F.from_json(F.get_json_object(given, "$.todos"), "array<struct<content:string,status:string>>")
    listed = F.array_join(F.transform(F.filter(todos, lambda t: t["content"].isNotNull()), lambda t: F.concat(F.lit("["), F.coalesce(t["status"], F.lit("pending")), F.lit("] "), t["content"])), "; ")
    more = {"MultiEdit": [field("edit_count", F.size(edits).cast("string")), field("old_string", text("$.edits[0].old_string", 200)), field("new_string", text("$.edits[0].new_string", 200))]}
    out = F.when(tool == "TodoWrite", F.array(field("todos", F.nullif(truncated(listed, 500), F.lit("")))))
    for name, fields in TELLING.items():
        out = out.when(tool == name, F.array(*[field(k, text(f"$.{k}", n)) for k, n in fields], *more.get(name, [])))
    return F.map_from_entries(F.coalesce(F.filter(out, lambda x: x["value"].isNotNull()), F.array().cast("array<struct<key:string,value:string>>")))
