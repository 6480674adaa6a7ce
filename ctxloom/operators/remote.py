"""Requests to remote embedding and chat services, as plain data; sending them is up to the caller.

A service object is any callable from a request body to a response body, called on executors.
"""
from __future__ import annotations

from collections.abc import Callable

from .ann import Embedder

Service = Callable[[dict], dict]


class RemoteError(RuntimeError):
    pass


def embedding_request(model: str, texts: list[str]) -> dict:
    return {"model": model, "input": list(texts)}


def read_embeddings(response: dict, n: int) -> list[list[float]]:
    """Vectors in the order asked, whatever the order of the answer."""
    rows = sorted(response.get("data", ()), key=lambda r: r["index"])
    if [r["index"] for r in rows] != list(range(n)):
        raise RemoteError(f"asked for {n} vectors, got {len(rows)}")
    return [list(map(float, r["embedding"])) for r in rows]


def remote_embedder(name: str, model: str, dimensions: int, send: Service) -> Embedder:
    """An embedder that asks once for each batch and not at all for an empty one."""

    def embed(texts: list[str]) -> list[list[float]]:
        return read_embeddings(send(embedding_request(model, texts)), len(texts)) if texts else []

    return Embedder(name, dimensions, embed)


def summary_request(model: str, prompt: str, instruction: str = "Summarize the blocks below; keep facts, names and decisions.", max_tokens: int = 1024) -> dict:
    return {"model": model, "max_tokens": max_tokens, "system": instruction, "messages": [{"role": "user", "content": prompt}]}


def read_summary(response: dict) -> str:
    text = "".join(part.get("text", "") for part in response.get("content", ()) if part.get("type") == "text")
    if not text:
        raise RemoteError("the answer has no text")
    return text


def remote_summarizer(model: str, send: Service, max_tokens: int = 1024) -> Callable[[str], str]:
    """A callable for reduce.external."""
    return lambda prompt: read_summary(send(summary_request(model, prompt, max_tokens=max_tokens))) if prompt else ""


def program(command: str) -> Service:
    """A service by a program that reads the request as JSON from its input and writes the response as JSON."""

    def send(body: dict) -> dict:
        import json
        import shlex
        import subprocess

        done = subprocess.run(shlex.split(command), input=json.dumps(body).encode(), capture_output=True)
        if done.returncode:
            raise RemoteError(f"{command}: exit {done.returncode}: {done.stderr.decode(errors='replace')[:500]}")
        return json.loads(done.stdout)

    return send
