"""The five requests as tools of the Model Context Protocol: JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import json
import os
import sys
from typing import TextIO

from tokenloom import model as m
from tokenloom.plans import contract as contracts
from tokenloom.plans.requests import Answer, Requests

PROTOCOL = "2025-06-18"
NOT_JSON, NOT_A_REQUEST, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602

#: Each tool: what it tells, and its arguments, all of them optional texts unless named in `needed`.
TOOLS = {
    "get_design_context": ("The design system in short, or one part of it.", {"category": "summary, all, tokens, components or conflicts; empty means summary", "tokenCategory": "only tokens of this category"}, []),
    "get_token": ("One token by its name.", {"name": "the token's name", "category": "where to look; empty means everywhere"}, ["name"]),
    "get_component": ("One component by its name.", {"name": "the component's name"}, ["name"]),
    "get_conflicts": ("What the sources disagree on, with suggested fixes.", {"type": "token, component or all", "status": "pending, resolved or all; empty means pending"}, []),
    "get_inferred_rules": ("Conventions inferred from the design system.", {"category": "only rules of this category"}, []),
}


class Error(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


class Server:
    """Answers over a contract.

    A watched server looks at the file once, at its start: after that a watcher hands each new contract to `take`, and what
    is being answered goes on with the old one. Without a watcher the file is looked at before each answer.
    """

    def __init__(self, path: str, told: TextIO | None = None, watched: bool = False) -> None:
        self.requests = Requests(None, path)
        self.told, self.watched, self.stamp = told or sys.stderr, watched, None
        self.load()

    def load(self) -> None:
        """The contract that is in the file, if it was rewritten; a missing or broken one changes nothing."""
        path = self.requests.path
        stamp = os.stat(path).st_mtime_ns if os.path.exists(path) else None
        if stamp == self.stamp:
            return
        self.stamp = stamp
        found = contracts.load(path, None)
        if found is not None:
            self.take(found)
        elif os.path.exists(path):
            print(f"tokenloom: the contract at {path} is not JSON", file=self.told)

    def take(self, contract: dict) -> None:
        """Answer from this contract from now on; one that was built for another project is told about."""
        self.requests.contract = contract
        if mismatch := self.requests.mismatch():
            print(f"tokenloom: {mismatch}", file=self.told)

    def call(self, tool: str, given: dict) -> Answer:
        if not self.watched:
            self.load()
        r = self.requests
        calls = {"get_design_context": r.design_context, "get_token": r.token, "get_component": r.component, "get_conflicts": r.conflicts, "get_inferred_rules": r.inferred_rules}
        if tool not in TOOLS:
            raise Error(BAD_PARAMS, f"there is no tool {tool}")
        _, arguments, needed = TOOLS[tool]
        if not isinstance(given, dict) or any(not isinstance(v, str) for v in given.values()) or any(n not in given for n in needed):
            raise Error(BAD_PARAMS, f"{tool} takes texts: {', '.join(arguments)}")
        return calls[tool](*[given.get(a, "") for a in arguments])

    def result(self, method: str, params: dict) -> dict:
        match method:
            case "initialize":
                asked = params.get("protocolVersion")
                return {"protocolVersion": asked if isinstance(asked, str) else PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "tokenloom", "version": m.CONTRACT_VERSION}}
            case "ping":
                return {}
            case "tools/list":
                text = lambda d: {"type": "string", "description": d}
                return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: text(v) for k, v in a.items()}, "required": needed}} for n, (d, a, needed) in TOOLS.items()]}
            case "tools/call":
                answer = self.call(params.get("name"), params.get("arguments") or {})
                shown = answer.error if answer.error else json.dumps(answer.payload, indent=2, ensure_ascii=False)
                return {"content": [{"type": "text", "text": shown}], "isError": answer.error is not None}
        raise Error(NO_METHOD, f"there is no method {method}")

    def answer(self, line: str) -> dict | None:
        """The response to a message; none to a notification."""
        number = None
        try:
            try:
                message = json.loads(line)
            except ValueError:
                raise Error(NOT_JSON, "not JSON") from None
            if not isinstance(message, dict) or not isinstance(message.get("method"), str):
                raise Error(NOT_A_REQUEST, "not a request")
            number = message.get("id")
            if "id" not in message:
                return None
            params = message.get("params") or {}
            if not isinstance(params, dict):
                raise Error(BAD_PARAMS, "parameters must be an object")
            return {"jsonrpc": "2.0", "id": number, "result": self.result(message["method"], params)}
        except Error as e:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": e.code, "message": str(e)}}

    def run(self, source: TextIO, sink: TextIO) -> None:
        for line in source:
            if line.strip() and (answer := self.answer(line)) is not None:
                sink.write(json.dumps(answer, ensure_ascii=False) + "\n")
                sink.flush()
