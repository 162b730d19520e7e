"""Tools for assistants: handlers, and a server of JSON-RPC lines over standard input and output."""

from __future__ import annotations

import json
import sys

from .commands import Engine
from .functions.text import parse_tag_list

INTERNAL_ERROR, NO_METHOD, BAD_REQUEST = -32603, -32601, -32700


def search_knowledge(engine: Engine, query: str, limit: int = 10, category: str | None = None) -> str:
    rows = engine.search(query, limit, category).collect()
    if not rows:
        return f"No results found for '{query}'."
    return f"Found {len(rows)} result(s) for '{query}':\n\n" + "\n".join(f"- **{r['title']}** ({r['path']}, line {r['line_number']}): {r['matched_line']}" for r in rows)


def list_knowledge(engine: Engine, category: str | None = None) -> str:
    rows = engine.list_documents(category).collect()
    if not rows:
        return "No documents found."
    return "\n".join(f"- **{r['title']}** [{r['category']}]" + (f" ({', '.join(r['tags'])})" if r["tags"] else "") + f": {r['path']}" for r in rows)


def get_document(engine: Engine, path: str) -> str:
    return engine.get(path)


def add_knowledge(engine: Engine, title: str, content: str, category: str, tags: str | None = None) -> str:
    doc = engine.add(title, content, category, parse_tag_list(tags))
    return f"Added **{doc.title}** to {doc.category}: {doc.path}"


TOOLS = {f.__name__: f for f in (search_knowledge, list_knowledge, get_document, add_knowledge)}
#: Parameters of each tool: name, type, whether it must be given.
PARAMETERS = {
    "search_knowledge": (("query", "string", True), ("limit", "integer", False), ("category", "string", False)),
    "list_knowledge": (("category", "string", False),),
    "get_document": (("path", "string", True),),
    "add_knowledge": (("title", "string", True), ("content", "string", True), ("category", "string", True), ("tags", "string", False)),
}


#: What an assistant reads in order to choose a tool.
DESCRIPTIONS = {
    "search_knowledge": "Finds lines that hold a text, whatever its case, in all documents of the corpora. Gives title, path, line number and line of each.",
    "list_knowledge": "Lists the documents that the corpora's manifests name, with category, tags and path; of one category, if it is given.",
    "get_document": "Gives a document's whole text, by its path as a manifest has it.",
    "add_knowledge": "Writes a new document into the first corpus and its manifest. Tags are separated by commas.",
}
MEANINGS = {
    "query": "the text to look for, as it stands",
    "limit": "the most results; 10 if left out",
    "category": "only documents of this category",
    "path": "path within its corpus, such as notes/first-steps.md",
    "title": "the title; the file's name follows from it",
    "content": "the document's text",
    "tags": "tags, separated by commas",
}
INSTRUCTIONS = "Corpora of documents with titles, categories and tags. Search first, then get the documents that look right; add what is worth keeping."


def described() -> list[dict]:
    schema = lambda ps: {"type": "object", "properties": {k: {"type": t, "description": MEANINGS[k]} for k, t, _ in ps}, "required": [k for k, _, must in ps if must]}
    return [{"name": n, "description": DESCRIPTIONS[n], "inputSchema": schema(ps)} for n, ps in PARAMETERS.items()]


def answer(engine: Engine, request: dict) -> dict | None:
    """The response to a request; none to a notification. Whatever a tool raises is an error of its call, not the server's end."""
    if not isinstance(request, dict) or not isinstance(request.get("params") or {}, dict):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": BAD_REQUEST, "message": "a request is an object with a method"}}
    reply = {"jsonrpc": "2.0", "id": request.get("id")}
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "tomehall", "version": "0.1.0"}, "instructions": INSTRUCTIONS}}
    if method == "tools/list":
        return reply | {"result": {"tools": described()}}
    if method == "tools/call" and params.get("name") in TOOLS:
        try:
            text = TOOLS[params["name"]](engine, **(params.get("arguments") or {}))
        except Exception as e:
            return reply | {"error": {"code": INTERNAL_ERROR, "message": str(e)}}
        return reply | {"result": {"content": [{"type": "text", "text": text}]}}
    return reply | {"error": {"code": NO_METHOD, "message": f"no method {method}"}}


def serve(engine: Engine, source=None, sink=None) -> None:
    source, sink = source or sys.stdin, sink or sys.stdout
    for line in source:
        if not line.strip():
            continue
        try:
            reply = answer(engine, json.loads(line))
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": BAD_REQUEST, "message": str(e)}}
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()
