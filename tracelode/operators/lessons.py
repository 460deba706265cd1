"""What a session teaches: failed calls, what followed them, and users' corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import usage

# The families of corrections, the strongest first, with their base scores.
CORRECTIONS = (
    ("explicit_rejection", 400, r"(?:^|[.!?]\s+)(?:(?:no|nope|nah)\s*[,!.:](?:\s|$)|(?:that(?:'s| is)|this is|you(?:'re| are))\s+(?:wrong|incorrect|mistaken|not\s+(?:what|the|right)\b))|\bnot what i (?:asked|requested|said|meant|wanted)\b"),
    ("performance_critique", 350, r"\bwhy\s+(?:did|are|do|don'?t|didn'?t|not)\s+you\b|\bhow many times\b|\byou\s+(?:keep|kept|failed|forgot|ignored|missed|misread|misunderstood|misinterpreted|didn'?t|did not|haven't|have not|weren't|were not|aren't|are not|can'?t|cannot)\b|\b(?:issues?|problems?)\s+with\s+your\s+(?:work|answer|response|analysis|implementation)\b|\byour\s+(?:work|answer|response|analysis|implementation)\b[^.!?\n]{0,80}\b(?:wrong|incorrect|incomplete|missing|broken|flawed)\b|\bi\s+(?:don'?t|do not)\s+understand\s+(?:your|why you|what you)\b|\b(?:losing faith|wasting (?:my )?time|sick of|frustrat(?:ed|ing|ion))\b"),
    ("intent_clarification", 300, r"\bwhat i\s+(?:actually|really)\s+(?:asked|requested|said|meant|wanted)\b|\bi\s+(?:didn'?t|did not)\s+(?:ask|request|say|mean|want)\b|\b(?:previous|original|last)(?:\s+[\w.-]+){0,8}\s+(?:request|instruction|task)\b[^.!?\n]{0,40}\bexactly\b"),
    ("behavioral_redirect", 250, r"(?:^|[.!?;]\s+)(?:please\s+)?stop\s+\w|(?:^|[.!?;]\s+)(?:please\s+)?never\s+(?:do|repeat|claim|try|use)\b|\bthis time\s+(?:don'?t|do not|stop|never)\s+\w|(?:^|[.!?;]\s+)(?:please\s+)?(?:continue|resume)\s+the\s+(?:previous|original|last)(?:\s+[\w.-]+){0,8}\s+(?:request|instruction|task)\b|(?:^|[.!?;]\s+)(?:please\s+)?(?:do|use|try|take|focus|proceed|leave|keep)\b[^.!?\n]{0,120}\binstead\b"),
)
# Git commands that only read, commands whose output is content, the words that give a failure away, and
# those of a patch that didn't apply.
READING_GIT = ("git log", "git show", "git diff", "git blame", "git status")
SHOWING = ("cat ", "sed ", "rg ", "grep ", "head ", "tail ", "find ", "ls ", "wc ", "git log", "git show", "git diff", "git blame", "git status")
SIGNATURE = r"(?i)(?:Segmentation fault|SIGSEGV|SIGABRT|panic|stack overflow|assertion failed|fatal error|thread .* panicked|Exit code (?:[1-9]\d*|1\d\d)|error\[E\d+\]|cannot find|unresolved|undefined reference)"
NOT_APPLIED = ("apply_patch verification failed", "Failed to find expected", "Invalid Context", "Patch failed")
# The kinds of the second dialect's tools by name.
TYPED = (
    ("shell", ("shell", "local_shell", "exec_command", "write_stdin", "container.exec")), ("file_write", ("apply_patch",)), ("file_read", ("read_file", "view_image")),
    ("web", ("web_search", "browser.search", "web.run")), ("search", ("grep", "find", "search")), ("orchestration", ("exec", "wait", "update_plan")),
)
#: What a summary carried over from another conversation holds.
CARRIED = ("All User Messages:", "conversation that ran out of context", "Key Technical Concepts:")


def correction(said: Column) -> Column:
    """struct(strength, basis) of a user's text, null if it corrects nothing: the strongest family's base and how many families match."""
    hits = [(name, base, said.rlike("(?im)" + pattern)) for name, base, pattern in CORRECTIONS]
    n = sum((F.coalesce(h.cast("int"), F.lit(0)) for _, _, h in hits[1:]), F.coalesce(hits[0][2].cast("int"), F.lit(0)))
    out = F.lit(None).cast("struct<strength:int,basis:string>")
    for name, base, hit in reversed(hits):
        out = F.when(hit, F.struct((n + base).alias("strength"), F.lit(name).alias("basis"))).otherwise(out)
    return out


def _begins(text: Column, prefixes: tuple[str, ...]) -> Column:
    t = F.ltrim(text)
    return F.coalesce(F.reduce(F.array(*[t.startswith(x) for x in prefixes]), F.lit(False), lambda a, x: a | x), F.lit(False))


def observing(command: Column) -> Column:
    """Whether a shell command only shows something."""
    return _begins(command, SHOWING)


def command_of(given: Column) -> Column:
    """The command of a shell call's input (JSON text): cmd or command, a string or a list of its words."""
    one = lambda k: F.coalesce(F.array_join(F.from_json(F.get_json_object(given, k), "array<string>"), " "), F.get_json_object(given, k))
    return F.coalesce(one("$.cmd"), one("$.command"))


def typed_kind(tool: Column) -> Column:
    """The kind of a tool of the second dialect."""
    out = None
    for kind, names in TYPED:
        out = F.when(tool.isin(*names), kind) if out is None else out.when(tool.isin(*names), kind)
    return out.when(tool.startswith("mcp") | tool.contains("__"), "mcp").otherwise("other")


def exit_code(content: Column) -> Column:
    """The code that a shell's result declares, in a line of its own or in a field."""
    line = F.regexp_extract(content, r"(?m)^\s*(?:Process exited with code |Exit code: )[^\S\n]*([+-]?\d+)\s*$", 1)
    v = F.try_parse_json(content)
    whole = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "BIGINT", F.try_variant_get(v, path, "int"))
    return F.coalesce(F.when(line != "", line.try_cast("int")), whole("$.exit_code"), whole("$.metadata.exit_code"))


def error_field(content: Column) -> Column:
    """Whether the content is a JSON object whose error is neither null nor false."""
    e = F.try_variant_get(F.try_parse_json(content), "$.error", "variant")
    kind = F.schema_of_variant(e)
    return F.coalesce((kind != "VOID") & ~((kind == "BOOLEAN") & ~F.coalesce(F.try_variant_get(e, "$", "boolean"), F.lit(True))), F.lit(False))


def _looks_fine(tool: Column, content: Column) -> Column:
    """Whether a flagged result looks like what a successful read, search, server or subagent returns."""
    return F.coalesce(
        ((tool == "Read") & content.rlike(r"^\s*[0-9]+[→\t]")) | ((tool == "Grep") & content.rlike(r"^\s*[0-9]+[:-]")) | (tool.startswith("mcp__") & F.ltrim(content).rlike(r"^[{\[]"))
        | ((tool == "Agent") & (F.octet_length(content) > 200) & ~content.startswith("Error")), F.lit(False)
    )


def _found(kind: str, basis: str) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(basis).alias("basis"))


def failure(tool: Column, given: Column, content: Column, is_error: Column) -> Column:
    """struct(kind, basis) of a call's result in the first dialect, null for one that holds; given is the input as JSON text.

    The native flag decides, unless the content looks like a success of its tool. Git commands that only read never
    fail otherwise. Then come an error field and last the text's own words. Without content only the flag counts.
    """
    none = F.lit(None).cast("struct<kind:string,basis:string>")
    return (
        F.when(F.coalesce(is_error, F.lit(False)), F.when(_looks_fine(tool, content), none).otherwise(_found("confirmed", "native_error_flag")))
        .when(content.isNull() | ((tool == "Bash") & _begins(F.get_json_object(given, "$.command"), READING_GIT)), none)
        .when(error_field(content), _found("confirmed", "structured_error"))
        .when(content.rlike(SIGNATURE), _found("inferred", "text_signature"))
        .otherwise(none)
    )


def typed_failure(tool: Column, given: Column, content: Column, is_error: Column, exit_: Column, success: Column, status: Column) -> Column:
    """struct(kind, basis) of a call's result in the second dialect, where tools have kinds and their ends were observed.

    An observed failure decides, then the flag, then an observed success. Searches that end with 1 found nothing and
    hold. What else can fail goes by the tool's kind: a shell by the code its result declares, unless it still runs or
    only shows something, then by an error field and its words; a patch by an error field or what a patch says that
    didn't apply; reads, searches and subagents in no other way; all other tools by an error field.
    """
    none, no = F.lit(None).cast("struct<kind:string,basis:string>"), lambda c: F.coalesce(c, F.lit(False))
    kind, command = typed_kind(tool), command_of(given)
    seeking = _begins(command, ("rg ", "grep "))
    found_nothing = no(exit_ == 1) & seeking
    declared = exit_code(content)
    shell = (
        F.when(declared.isNotNull(), F.when((declared == 0) | ((declared == 1) & seeking), none).otherwise(_found("confirmed", "process_exit")))
        .when(content.contains("Process running with session ID") | observing(command), none)
        .when(error_field(content), _found("confirmed", "structured_error"))
        .when(F.ltrim(content).startswith("Error:") | content.rlike(SIGNATURE), _found("inferred", "text_signature"))
        .otherwise(none)
    )
    structured = F.when(error_field(content), _found("confirmed", "structured_error"))
    patch = structured.when(F.reduce(F.array(*[content.contains(x) for x in NOT_APPLIED]), F.lit(False), lambda a, x: a | x), _found("inferred", "text_signature")).otherwise(none)
    return (
        F.when(no(exit_ != 0) & ~found_nothing, _found("confirmed", "process_exit"))
        .when(no(~success | status.isin("failed", "declined")) & ~found_nothing, _found("confirmed", "native_lifecycle_status"))
        .when(no(is_error), _found("confirmed", "native_error_flag"))
        .when(content.isNull() | exit_.isNotNull() | no(success) | no(status == "completed"), none)
        .when(kind == "shell", shell).when(kind == "file_write", patch).when(kind.isin("file_read", "search"), none).otherwise(structured.otherwise(none))
    )


def failures(blocks: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """Calls whose result failed, with kind and basis.

    Without observed, blocks are the first dialect's. observed(session_key, call_id, exit_code, success, status) are
    the observed ends of the second dialect's calls; there its own rules hold.
    """
    c = usage.tool_calls(blocks)
    if observed is None:
        said = failure(F.col("tool_name"), F.col("input"), F.col("result"), F.col("failed"))
    else:
        c = c.join(observed.select("session_key", F.col("call_id").alias("id"), "exit_code", "success", "status"), ["session_key", "id"], "left")
        said = typed_failure(F.col("tool_name"), F.col("input"), F.col("result"), F.col("failed"), F.col("exit_code"), F.col("success"), F.col("status"))
    c = c.filter("result_line is not null").withColumn("failure", said)
    return c.filter("failure is not null").select("session_key", "id", "line_no", "result_line", "ts", "tool_name", "input", "result", "failure.kind", "failure.basis")


def error_fixes(entries: DataFrame, blocks: DataFrame, observed: DataFrame | None = None) -> DataFrame:
    """Failed calls with what was given and what the assistant's next entry says and calls.

    (session_key, id, tool_name, kind, basis, given, preview, error, fix_line, resolution, resolution_tools): given is
    a map of the input's telling fields, preview the error's beginning, error the normalised one, by which equal ones
    of different sessions meet. Where no entry of the assistant follows, fix_line is null.
    """
    f = failures(blocks, observed)
    talk = entries.filter("entry_type = 'assistant'").select("session_key", F.col("line_no").alias("then"))
    # a line after each failure: both in one order, and the failure looks on
    rows = f.select("session_key", F.col("result_line").alias("at"), "id").unionByName(talk.select("session_key", F.col("then").alias("at"), F.lit(None).cast("string").alias("id")))
    w = Window.partitionBy("session_key").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    fix = rows.withColumn("fix_line", F.first(F.when(F.col("id").isNull(), F.col("at")), ignorenulls=True).over(w)).filter("id is not null").select("session_key", "id", "fix_line")
    part = lambda kind, c: F.transform(F.sort_array(F.collect_list(F.when(F.col("block_type") == kind, F.struct("block_no", F.col(c).alias("x"))))), lambda x: x["x"])
    said = blocks.filter("entry_type = 'assistant'").groupBy("session_key", F.col("line_no").alias("fix_line")).agg(F.trim(F.array_join(part("text", "text"), "\n")).alias("said"), part("tool_use", "tool_name").alias("resolution_tools"))
    return f.join(fix, ["session_key", "id"]).join(said, ["session_key", "fix_line"], "left").select(
        "session_key", "id", "tool_name", "kind", "basis", text.input_summary(F.col("tool_name"), F.col("input")).alias("given"),
        F.coalesce(text.truncated(F.trim("result"), 300), F.lit("(error with no content)")).alias("preview"), text.normal_error(F.col("tool_name"), F.col("result")).alias("error"),
        "fix_line", F.when(F.col("said") != "", text.truncated(F.col("said"), 200)).alias("resolution"), F.coalesce("resolution_tools", F.array().cast("array<string>")).alias("resolution_tools"),
    )


def corrections(blocks: DataFrame, human: DataFrame) -> DataFrame:
    """(session_key, line_no, strength, basis, said, before): users' texts that correct the assistant, with what it had said.

    human(session_key, line_no) are the prompts that people wrote. A text without an assistant's entry before it, one of
    ten bytes or less, one of over 3,000, and summaries carried over don't count.
    """
    t = blocks.filter("entry_type in ('user', 'assistant')").groupBy("session_key", "line_no", "entry_type").agg(
        F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("block_type") == "text", F.struct("block_no", "text")))), lambda x: x["text"]), "\n")).alias("said")
    )
    before = Window.partitionBy("session_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("entry_type") == "assistant", F.struct("said")), ignorenulls=True).over(before)
    t = t.withColumn("was", last["said"]).filter("entry_type = 'user' and was <> ''").join(human.select("session_key", "line_no"), ["session_key", "line_no"], "left_semi")
    carried = F.reduce(F.array(*[F.col("said").contains(x) for x in CARRIED]), F.lit(False), lambda a, x: a | x)
    t = t.filter((F.octet_length("said") > 10) & (F.octet_length("said") <= 3000) & ~carried).withColumn("c", correction(F.col("said"))).filter("c is not null")
    return t.select("session_key", "line_no", "c.strength", "c.basis", text.truncated(F.col("said"), 300).alias("said"), text.truncated(F.col("was"), 200).alias("before"))


def recurring(fixes: DataFrame, least: int = 2) -> DataFrame:
    """Errors that several sessions had."""
    return fixes.groupBy("error").agg(F.count("*").alias("n"), F.count_distinct("session_key").alias("sessions")).filter((F.col("n") >= least) & (F.col("sessions") >= least))
