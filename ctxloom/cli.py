"""Command line: python -m ctxloom.cli --store PATH COMMAND ..."""
from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .api import Store
from .operators.remote import program, remote_summarizer
from .plans.config import Config, loads


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ctxloom")
    p.add_argument("--store", required=True)
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), [c.add_argument(a) if isinstance(a, str) else c.add_argument(a[0], **a[1]) for a in args]]
    flag, opt = {"action": "store_true"}, {"default": None}
    add("init")
    add("put", "session", "kind", "file", ("--priority", {"type": float, "default": 0.0}))
    add("list-models")
    for name in ("page", "pack"):
        add(name, "session", "model", ("--task", {"default": ""}), ("--required", {"action": "append", "default": []}), ("--json", flag), ("--chat", flag), ("--trace", flag), ("--prompt-only", flag), ("--timestamps", flag))
    add("trace-show", "call")
    add("trace-diff", "prev", "next")
    add("list-sessions")
    add("verify")
    add("repair", ("--yes", flag))
    add("purge", ("--block", opt), ("--session", opt), ("--yes", flag))
    add("show", "block", ("--json", flag))
    add("add-edge", "source", "target", "kind")
    add("edges", "block", ("--incoming", flag), ("--outgoing", flag))
    add("summarize", "session", ("--last", {"type": int, "default": None}), ("--store-summary", flag), ("--summarizer", {"choices": ["truncating", "noop", "external"], "default": "truncating"}), ("--max-chars", {"type": int, "default": 80}),
        ("--command", {"dest": "ask", "default": None, "help": "external: a program that reads a request body as JSON and writes the answer's"}), ("--model", {"default": ""}), ("--max-tokens", {"type": int, "default": 1024}))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a = _parser().parse_args(argv)
    out = out or sys.stdout
    say = lambda *x, **k: print(*x, file=out, **k)
    if a.command in ("repair", "purge") and not a.yes:
        say(f"{a.command} changes the store; repeat with --yes")
        return 2
    if a.command == "summarize" and (a.summarizer == "external") != bool(a.ask and a.model):
        say("an external summarizer needs --command and --model, and no other takes them")
        return 2
    if a.command == "purge" and (a.block is None) == (a.session is None):
        say("purge needs exactly one of --block and --session")
        return 2
    config = Config()
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            config = loads(f.read())
    s = Store(spark or SparkSession.builder.appName("ctxloom").getOrCreate(), a.store, config)
    match a.command:
        case "init":
            say(s.disk.version)
        case "put":
            body = sys.stdin.buffer.read() if a.file == "-" else open(a.file, "rb").read()
            say(s.put(a.session, a.kind, body, a.priority))
        case "list-models":
            for m in s.list_models():
                say(m["name"], m["input_budget"], m["tokenizer"])
        case "page":
            p = s.page(a.session, a.model, a.task, a.required)
            if a.json:
                say(json.dumps({"selected": p.selected, "omitted": p.omitted, "estimated_tokens": p.estimated_tokens}))
            else:
                for b, score, reason in p.selected:
                    say("+", b, f"{score:.4f}", reason)
                for b, score, reason in p.omitted:
                    say("-", b, f"{score:.4f}", reason)
        case "pack":
            r = s.pack(a.session, a.model, a.task, a.required, chat=a.chat, trace=a.trace, timestamps=True if a.timestamps else None)
            if a.chat:
                say(json.dumps({"messages": r.messages, "cache_boundary": r.cache_boundary, "input_tokens": r.tokens}))
            elif a.prompt_only:
                say(r.rendered, end="")
            elif a.json:
                say(json.dumps({"rendered": r.rendered, "input_tokens": r.tokens, "selected": r.plan.selected, "omitted": r.plan.omitted}))
            else:
                say(r.rendered)
                say(f"[{len(r.plan.selected)} block(s), {len(r.plan.omitted)} left out, {r.tokens} tokens]")
            if r.call_id and not a.prompt_only:
                say("call", r.call_id)
        case "trace-show":
            say(json.dumps(s.trace(a.call), default=str))
        case "trace-diff":
            rows, summary = s.diff(a.prev, a.next)
            for r in rows:
                say({"added": "+", "removed": "-", "kept": "~" if r["reason_changed"] else "="}[r["change"]], r["block_id"])
            say(summary)
        case "list-sessions":
            for x in s.list_sessions():
                say(x)
        case "verify":
            v = s.verify()
            say(json.dumps(v))
            return 0 if v["is_clean"] else 1
        case "repair":
            say("quarantined", *s.repair())
        case "purge":
            say(s.delete(a.block) if a.block else s.purge_session(a.session))
        case "show":
            b = s.show(a.block)
            if b is None:
                say("no such block")
                return 1
            try:
                text = bytes(b["body"]).decode()
            except UnicodeDecodeError:
                text = bytes(b["body"][:256]).hex(" ")
            say(json.dumps(b | {"body": text}) if a.json else f"{b['block_id']} {b['kind']} {b['content_hash']}\n{text}")
        case "add-edge":
            s.add_edge(a.source, a.target, a.kind)
        case "edges":
            for kind, to in s.edges_from(a.block) if a.outgoing or not a.incoming else ():
                say("->", kind, to)
            for kind, source in s.edges_to(a.block) if a.incoming or not a.outgoing else ():
                say("<-", kind, source)
        case "summarize":
            ask = remote_summarizer(a.model, program(a.ask), a.max_tokens) if a.ask else None
            say(s.summarize(a.session, a.last, a.max_chars, a.store_summary, a.summarizer, ask))
    return 0


if __name__ == "__main__":
    sys.exit(main())
