"""Schemas of the engine's tables and the domains of their codes."""

from __future__ import annotations

TOOL_CALLS = "array<struct<id:string,function:struct<name:string,arguments:string>>>"
#: A conversation log; (conv_id, turn) orders it.
MESSAGE = f"role string, content string, name string, tool_calls {TOOL_CALLS}, tool_call_id string"
LOG = f"conv_id long, turn long, {MESSAGE}"
TOOL_RESULT = "struct<output:string,error:string>"
ERROR = "struct<kind:string,message:string>"
PLAN = (
    "struct<name:string,description:string,repository:string,"
    "steps:array<struct<id:string,description:string,action:struct<type:string,params:struct<category:string,command:string,prompt:string>>,dependencies:array<string>>>,"
    "deliverables:array<struct<name:string,description:string,path:string>>>"
)

# fixed values: roles, actions with their parameter, categories with their directories
ROLES = ("system", "user", "assistant", "tool")
ACTIONS = {"scan_repository": None, "analyze_code": None, "generate_docs": "category", "execute_command": "command", "agent_task": "prompt"}
CATEGORIES = {"tutorial": "docs/tutorials", "how-to": "docs/how_to", "explanation": "docs/explanation", "reference": "docs/reference"}
PLAN_FORMATS = {"yaml": "yaml", "yml": "yaml", "json": "json", "md": "markdown", "markdown": "markdown"}
#: Estimated tokens of a conversation's budget, and model calls of one run.
CONTEXT_TOKENS = 4096
MOST_ROUNDS = 5
