"""Hook envelopes and tool inputs: whether they fit their event or tool, with a code and issues with paths.

Both are tables in text (see ``functions.shape``). Not looked into: the format of UUIDs and
URLs, page ranges, the length of a question's header, its options, and the inner fields of
permission suggestions, answers and annotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import rules, shape
from threadloom.functions.text import bound

# What every envelope has.
BASE = "session_id some, transcript_path some, cwd some, prompt_id string?, permission_mode =default|plan|acceptEdits|auto|dontAsk|bypassPermissions?, agent_id string?, agent_type string?, effort object?"
# The events and their own fields; "some" is a string that isn't empty.
EVENTS = """
SessionStart: source =startup|resume|clear|compact, model string?, session_title string?
Setup: trigger =init|maintenance
UserPromptSubmit: prompt string
UserPromptExpansion: expansion_type =slash_command|mcp_prompt, command_name some, command_args string, command_source some, prompt string
PreToolUse: tool_name some, tool_input object, tool_use_id some
PermissionRequest: tool_name some, tool_input object, permission_suggestions array?
PermissionDenied: tool_name some, tool_input object, tool_use_id some, reason some
PostToolUse: tool_name some, tool_input object, tool_response object, tool_use_id some, duration_ms number?
PostToolUseFailure: tool_name some, tool_input object, tool_use_id some, error string, is_interrupt boolean?, duration_ms number?
PostToolBatch: tool_calls array
Notification: message string, title string?, notification_type =permission_prompt|idle_prompt|auth_success|elicitation_dialog|elicitation_complete|elicitation_response|agent_needs_input|agent_completed
MessageDisplay: turn_id some, message_id some, index unsigned, final boolean, delta string
SubagentStart: agent_id string, agent_type string
SubagentStop: stop_hook_active boolean, agent_id string, agent_type string, agent_transcript_path string, last_assistant_message string?, background_tasks array?, session_crons array?
TaskCreated: task_id some, task_subject some, task_description string?, teammate_name string?, team_name string?
TaskCompleted: task_id some, task_subject some, task_description string?, teammate_name string?, team_name string?
Stop: stop_hook_active boolean, last_assistant_message string?, background_tasks array?, session_crons array?
StopFailure: error =rate_limit|overloaded|authentication_failed|oauth_org_not_allowed|billing_error|invalid_request|model_not_found|server_error|max_output_tokens|unknown, error_details string?, last_assistant_message string?
TeammateIdle: teammate_name some, team_name some
InstructionsLoaded: file_path some, memory_type =User|Project|Local|Managed, load_reason =session_start|nested_traversal|path_glob_match|include|compact, globs strings?, trigger_file_path string?, parent_file_path string?
ConfigChange: source =user_settings|project_settings|local_settings|policy_settings|skills, file_path string?
CwdChanged: old_cwd some, new_cwd some
FileChanged: file_path some, event =change|add|unlink
WorktreeCreate: name some
WorktreeRemove: worktree_path some
PreCompact: trigger =manual|auto, custom_instructions string
PostCompact: trigger =manual|auto, compact_summary string
Elicitation: mcp_server_name some, message string, elicitation_id string?, mode =form|url?, requested_schema object?, url string?
ElicitationResult: mcp_server_name some, action =accept|decline|cancel, content object?, mode =form|url?, elicitation_id string?
SessionEnd: reason =clear|resume|logout|prompt_input_exit|bypass_permissions_disabled|other
"""
# The tools' inputs.
TOOLS = """
Bash: command some, description string?, timeout positive?, run_in_background boolean?, dangerouslyDisableSandbox boolean?
Write: file_path some, content string
Edit: file_path some, old_string string, new_string string, replace_all boolean?
Read: file_path some, offset nonnegative?, limit positive?, pages some?
Glob: pattern some, path string?
Grep: pattern some, path string?, glob string?, type string?, output_mode =content|files_with_matches|count?, multiline boolean?, -i boolean?, -n boolean?, -A nonnegative?, -B nonnegative?, -C nonnegative?
MultiEdit: file_path some, edits array
WebFetch: url some, prompt some
WebSearch: query some, allowed_domains strings?, blocked_domains strings?
Agent: prompt some, description some?, subagent_type string?, model string?, run_in_background boolean?, isolation =worktree|remote?
AskUserQuestion: questions array, answers object?, annotations object?, metadata object?
ExitPlanMode: plan string, planFilePath some, allowedPrompts array?
TodoWrite: todos array
Task: prompt some, description string?, subagent_type string?, model string?, run_in_background boolean?
"""
# The items of an event's and of a tool's lists.
EVENT_ITEMS = """
background_tasks: id some, type some, status some, description string, command string?, agent_type string?, server string?, tool string?, name string?
session_crons: id some, schedule some, recurring boolean, prompt string
tool_calls: tool_name some, tool_input object, tool_use_id some, tool_response string|array
"""
TOOL_ITEMS = """
edits: old_string string, new_string string, replace_all boolean?
todos: content some, status =pending|in_progress|completed, activeForm some
questions: question some, header some, options array, multiSelect boolean?
allowedPrompts: tool some, prompt string
"""
#: How many items the lists must have that may not be empty, at most.
MOST = {"tool_calls": None, "questions": 4}


def _string(v: Column, path: str) -> Column:
    return bound(F.try_variant_get(v, path, "variant"), lambda x: F.when(shape.kind_of(x) == "string", F.try_variant_get(x, "$", "string")))


def _list_issues(v: Column, at: str, items: str, tag: Column, table: str) -> Column:
    """Issues of the lists that the tag has: wrong_items, or wrong_size of one that must have some."""
    of = shape.rules_of_text(table)
    out = []
    for name, own in shape.rules_of_text(items).items():
        tags = [t for t, fields in of.items() if any(key == name for _, key, _, _ in fields)]
        path = ".".join(filter(None, (at, name)))

        def told(found: Column, name=name, own=own, path=path) -> Column:
            size = F.size(found)
            wrong_size = (size == 0) | (size > F.lit(MOST[name])) if MOST.get(name) else (size == 0) if name in MOST else F.lit(False)
            code = F.when(found.isNull(), None).when(wrong_size, "wrong_size").when(~shape.all_fit(found, own), "wrong_items")
            return F.when(code.isNotNull(), F.struct(code.alias("code"), F.lit(path).alias("path")))

        out.append(bound(F.when(tag.isin(*tags), F.try_variant_get(v, f"$.{path}", "array<variant>")), _one(told)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _one(f):
    """f with its first argument alone, as a lambda's other arguments would be taken for an index."""
    return lambda x: f(x)


def hook_envelopes(rows: DataFrame, json_col: str = "value") -> DataFrame:
    """rows with event, code (null: valid) and issues of the envelope in a JSON column.

    Codes: INVALID_INPUT_TYPE (no object, or no JSON), MISSING_HOOK_EVENT_NAME,
    UNSUPPORTED_HOOK_EVENT, HOOK_VALIDATION_FAILED.
    """
    base = shape.rules_of_text(f"base: {BASE}")["base"]
    # an event's own rule of a field stands for the one that all have
    table = {tag: [r for r in base if r[1] not in {key for _, key, _, _ in own}] + own for tag, own in shape.rules_of_text(EVENTS).items()}

    def told(v: Column) -> Column:
        event = _string(v, "$.hook_event_name")

        def of_event(event: Column) -> Column:
            level = shape.issues(shape.kinds(v, ("effort",)), shape.lookup({"": [("effort", "level", "=low|medium|high|xhigh|max", False)]}, F.lit("")))
            found = F.concat(shape.issues(shape.kinds(v, ("",)), shape.lookup(table, event)), level, _list_issues(v, "", EVENT_ITEMS, event, EVENTS))
            known = event.isin(*table)
            code = lambda found: F.when(F.try_variant_get(v, "$", "map<string,variant>").isNull(), "INVALID_INPUT_TYPE").when(event.isNull(), "MISSING_HOOK_EVENT_NAME").when(~known, "UNSUPPORTED_HOOK_EVENT").when(F.size(found) > 0, "HOOK_VALIDATION_FAILED")
            return bound(F.when(known, found), lambda found: F.struct(event.alias("event"), code(found).alias("code"), found.alias("issues")))

        return bound(event, of_event)

    return rows.withColumn("_h", bound(F.try_parse_json(json_col), told)).select(*rows.columns, "_h.*")


def tool_inputs(rows: DataFrame, json_col: str = "value") -> DataFrame:
    """rows with tool, code (null: valid) and issues of the tool input in an envelope's JSON.

    Codes: UNSUPPORTED_TOOL, TOOL_VALIDATION_FAILED, MCP_TOOL_VALIDATION_FAILED (the input of a
    server's tool is no object).
    """
    table = {tag: [("tool_input", key, kind, maybe) for _, key, kind, maybe in own] for tag, own in shape.rules_of_text(TOOLS).items()}

    def told(v: Column) -> Column:
        def of_tool(tool: Column) -> Column:
            given = F.try_variant_get(v, "$.tool_input", "map<string,variant>").isNotNull()
            none = F.array(F.struct(F.lit("wrong_type").alias("code"), F.lit("tool_input").alias("path")))
            own = F.concat(shape.issues(shape.kinds(v, ("tool_input",)), shape.lookup(table, tool)), _list_issues(v, "tool_input", TOOL_ITEMS, tool, TOOLS))
            known, served = tool.isin(*table), rules.is_mcp_tool(tool)
            found = F.when(known, F.when(given, own).otherwise(none)).when(served & ~given, none)
            failed = lambda found: F.when(F.size(found) > 0, F.when(known, "TOOL_VALIDATION_FAILED").otherwise("MCP_TOOL_VALIDATION_FAILED"))
            code = lambda found: F.when(~F.coalesce(known | served, F.lit(False)), "UNSUPPORTED_TOOL").otherwise(failed(found))
            return bound(found, lambda found: F.struct(tool.alias("tool"), code(found).alias("code"), found.alias("issues")))

        return bound(_string(v, "$.tool_name"), of_tool)

    return rows.withColumn("_t", bound(F.try_parse_json(json_col), told)).select(*rows.columns, "_t.*")
