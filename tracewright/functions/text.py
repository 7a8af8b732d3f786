"""Column functions over command, output and reply texts. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error words, success marks, rollback commands, offload marks and tool classes; fixed values.
ERROR_RX = r"(?i)\b(error|exception|traceback|undefined|cannot find|failed|fatal|not found|syntax error|unresolved|permission denied|no such file|abort|segmentation fault|command not found)\b"
SUCCESS_RX = r"(?i)\b(build (succeeded|successful)|compilation (successful|ok)|passed|passing|\bok\b|finished in \d|tests? (passed|ok)|\[==========\] .* passed|all tests passed)\b"
ROLLBACK_RX = r"(?i)\bgit (revert|reset --?hard|stash|checkout --? )|\bundo\b|rollback"
OFFLOAD_RX = r"(?i)\bsaved to [\w/.-]+|offloaded|\[truncated\]"
REMINDER_RX = r"(?is)<system-reminder>.*?</system-reminder>"
SPACE = r"[ \t\n\x0b\f\r]+"
TOOLS = {"Bash": "bash", "bash": "bash", "Read": "view", "view": "view", "Edit": "edit", "Write": "edit", "MultiEdit": "edit", "Grep": "search", "Glob": "search", "Agent": "other", "Task": "other", "TodoRead": "other", "TodoWrite": "other"}


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "")


def has_error(text: Column) -> Column:
    return F.coalesce(text.rlike(ERROR_RX), F.lit(False))


def has_success(text: Column) -> Column:
    return F.coalesce(text.rlike(SUCCESS_RX), F.lit(False))


def is_rollback(command: Column) -> Column:
    return F.coalesce(command.rlike(ROLLBACK_RX), F.lit(False))


def is_offloaded(text: Column) -> Column:
    return F.coalesce((F.length(text) < 4096) & text.rlike(OFFLOAD_RX), F.lit(False))


def command_signature(cmd: Column) -> Column:
    return F.left(F.concat_ws(" ", F.slice(F.split(trim_space(cmd), SPACE), 1, 3)), F.lit(80))


def error_signature(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), trim_space), lambda x: x != "")
    return F.left(F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(ERROR_RX)), F.lit(0)), F.get(lines, F.lit(0)), F.lit("")), F.lit(120))


def tool_class(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TOOLS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), F.lit("other"))


def truncate_output(text: Column, first: int = 15, last: int = 10) -> Column:
    lines = F.split(text, "\n")
    n = F.size(lines)
    cut = F.concat_ws("\n", F.concat_ws("\n", F.slice(lines, 1, first)), F.format_string("[... %s lines omitted ...]", n - first - last), F.concat_ws("\n", F.slice(lines, F.greatest(n - last + 1, F.lit(1)), F.lit(last))))
    return F.when(n <= first + last + 3, text).otherwise(cut)


def truncate_middle(text: Column, most: int = 8000) -> Column:
    """First and last halves of a text longer than ``most`` around a mark with its whole length."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most // 2)), F.format_string("\n... [truncated, total %s chars]\n", F.length(text)), F.right(text, F.lit(most // 2)))).otherwise(text)


def cap_response(text: Column, most: int = 500) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n[truncated]"))).otherwise(text)


def numbered_lines(text: Column, most: int = 500) -> Column:
    """A file as the reading tool shows it: its first ``most`` lines, then a mark if there are more, each with its number."""
    lines = F.split(F.regexp_replace(text, r"(\r\n|[\n\r])\z", ""), r"\r\n|[\n\r]")
    shown = F.when(F.size(lines) > most, F.concat(F.slice(lines, 1, most), F.array(F.lit(f"... [truncated at {most} lines]")))).otherwise(lines)
    return F.when(text == "", "").otherwise(F.array_join(F.transform(shown, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n"))


def parse_verdict(text: Column) -> Column:
    """struct<should, reason, summary> of a judge's reply. The answer may be in any case, the marks before reason and summary not;
    a reason is one line, the next one if its own is blank; a blank one is ''."""
    got = lambda rx: F.when(F.regexp_instr(text, F.lit(rx)) > 0, trim_space(F.regexp_extract(text, rx, 1)))
    return F.struct(F.upper(got(r"(?iU)SHOULD_CHECKPOINT:\s*(YES|NO)\b")).alias("should"), got(r"(?U)REASON:\s*(.+)").alias("reason"), got(r"(?sU)SUMMARY:\s*(.+)").alias("summary"))


def parse_tool_call(text: Column) -> Column:
    """struct<name, arguments> of the first call in a reply; the last of repeated parameters counts; else null."""
    rx = r"(?sU)<tool_call>\s*<function=(\w+)>(.*?)</function>\s*</tool_call>"
    name, body = F.regexp_extract(text, rx, 1), F.regexp_extract(text, rx, 2)
    par = r"(?sU)<parameter=(\w+)>\s*(.*?)\s*</parameter>"
    keys, values = F.regexp_extract_all(body, F.lit(par), F.lit(1)), F.regexp_extract_all(body, F.lit(par), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), p["k"]))
    return F.when(name != "", F.struct(name.alias("name"), F.map_from_entries(last).alias("arguments")))


def is_checkpoint(name: Column) -> Column:
    """A parsed call is a checkpoint by its exact name."""
    return F.coalesce(name == "mcp__bookmarks__checkpoint_progress", F.lit(False))


def summary_text(kind: Column, finding: Column, evidence: Column, next_direction: Column, legacy: Column) -> Column:
    """One line of a checkpoint that says anything structured, as a milestone unless an approach was eliminated; else the legacy summary; else ''."""
    label = F.when(kind == "approach_eliminated", "Approach eliminated").otherwise("Milestone")
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    part = lambda name, c: F.when(has(c), F.concat(F.lit(name), c))
    full = F.concat_ws(". ", F.concat(label, F.lit(": "), F.coalesce(finding, F.lit(""))), part("Evidence: ", evidence), part("Next: ", next_direction))
    return F.when(has(finding) | has(evidence) | has(next_direction), full).otherwise(F.coalesce(legacy, F.lit("")))


def extract_usage(body: Column, most: int | None = None) -> Column:
    """The first usage of an event stream or JSON body: struct<input_tokens, cache_creation, cache_read, output_tokens>.

    A count that is no number is null, a fraction loses what stands behind the point. The whole body is read; a caller that only holds the head of a body says so by ``most`` characters.
    """
    head = body if most is None else F.left(body, F.lit(most))
    events = F.transform(F.filter(F.split(head, "\n"), lambda x: F.startswith(x, F.lit("data: "))), lambda x: trim_space(F.substr(x, F.lit(7))))
    usage = lambda x: F.coalesce(F.get_json_object(x, "$.message.usage"), F.get_json_object(x, "$.usage"))
    found = F.filter(F.transform(events, usage), lambda x: F.startswith(x, F.lit("{")))
    raw = F.coalesce(F.get(found, F.lit(0)), F.get_json_object(head, "$.usage"))
    n = lambda k: F.get_json_object(raw, f"$.{k}").try_cast("double").try_cast("bigint")
    return F.when(F.startswith(raw, F.lit("{")), F.struct(n("input_tokens").alias("input_tokens"), n("cache_creation_input_tokens").alias("cache_creation"), n("cache_read_input_tokens").alias("cache_read"), n("output_tokens").alias("output_tokens")))


def estimate_tokens(text: Column) -> Column:
    """Four characters a token."""
    return F.floor(F.length(text) / 4).cast("bigint")


def session_key(texts: Column) -> Column:
    """First non-empty user text without reminders, 200 characters; ``texts`` is in order."""
    clean = F.filter(F.transform(texts, lambda t: trim_space(F.regexp_replace(t, REMINDER_RX, ""))), lambda t: t != "")
    return F.coalesce(F.left(F.get(clean, F.lit(0)), F.lit(200)), F.lit("__default__"))


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def render_step(idx: Column, role: Column, tool: Column, cmd: Column, output: Column, text: Column, most: int = 2000) -> Column:
    """A step as one prompt entry."""
    number = F.format_string("[%3d] ", idx)
    cmd, tool, text = (F.coalesce(c, F.lit("")) for c in (cmd, tool, text))
    over = lambda c, n, form: F.when(F.length(c) > n, F.format_string(form, F.length(c) - n)).otherwise("")
    said = lambda who: F.concat(number, F.lit(who), F.left(text, F.lit(500)), over(text, 500, "  (…%s more chars)"))
    out = truncate_output(F.coalesce(output, F.lit("")))
    shown = F.concat(F.left(out, F.lit(most)), over(out, most, "\n[... %s chars truncated ...]"))
    call = F.concat(number, F.lit("TOOL "), tool, F.lit(": "), F.left(cmd, F.lit(200)), over(cmd, 200, " (…%s)"), F.lit("\n     → "), shown)
    return F.when(role == "user_text", said("USER: ")).when(role == "assistant_text", said("ASST: ")).otherwise(call)


#: What a checkpoint may say, and the headers that a side request may carry; fixed values.
PROGRESS_TYPES = ["milestone_achieved", "approach_eliminated"]
PASSED_HEADERS = ["authorization", "x-api-key", "anthropic-version", "anthropic-beta", "user-agent"]


def missing_fields(kind: Column, finding: Column, evidence: Column, next_direction: Column) -> Column:
    """The fields that a checkpoint lacks, by name; none for a valid one."""
    blank = lambda c: trim_space(F.coalesce(c, F.lit(""))) == ""
    named = [F.when(~F.coalesce(kind.isin(PROGRESS_TYPES), F.lit(False)), "progress_type")] + [F.when(blank(c), n) for n, c in (("finding", finding), ("evidence", evidence), ("next_direction", next_direction))]
    return F.array_compact(F.array(*named))


def checkpoint_ack(kind: Column, finding: Column, evidence: Column, next_direction: Column) -> Column:
    """What the checkpoint tool answers to a valid call."""
    label = F.when(kind == "milestone_achieved", "Milestone").otherwise("Approach eliminated")
    return F.concat(label, F.lit(": "), finding, F.lit(". Evidence: "), evidence, F.lit(". Next: "), next_direction, F.lit(". Prior exploration will be condensed for focus; the full history remains accessible via bookmark_recall."))


def passed_headers(headers: Column) -> Column:
    """The headers (a map) that a side request may carry, names in any case, beside its own."""
    own = {"content-type": "application/json", "accept": "application/json", "accept-encoding": "identity"}
    kept = F.map_filter(headers, lambda k, v: F.lower(k).isin(PASSED_HEADERS))
    return F.map_concat(F.create_map(*[F.lit(x) for kv in own.items() for x in kv]), F.coalesce(kept, F.create_map().cast("map<string,string>")))
