"""Registry of queries and of the shared SQL blocks their twins are built from."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafloom.session import Tables

Runner = Callable[[Tables], DataFrame]

QUERIES: dict[str, Runner] = {}
SQL: dict[str, str] = {}
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {}


def block(name: str, body: str, *needs: str) -> None:
    """A named common table expression and the ones it reads."""
    BLOCKS[name] = (needs, body.strip())


def again(names: list[str], prefix: str, sources: dict[str, str]) -> None:
    """Blocks once more as ``<prefix>_<name>``, reading each other and, in place of some blocks, others."""
    renamed = {n: f"{prefix}_{n}" for n in names} | sources
    table = re.compile(rf"\b(FROM|JOIN) ({'|'.join(sorted(renamed, key=len, reverse=True))})\b")
    for n in names:
        needs, body = BLOCKS[n]
        block(renamed[n], table.sub(lambda m: f"{m[1]} {renamed[m[2]]}", body), *[renamed.get(x, x) for x in needs])


def with_blocks(body: str, *needs: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in BLOCKS[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for need in needs:
        visit(need)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{n} AS (\n{BLOCKS[n][1]}\n)" for n in ordered)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()) -> Callable[[Runner], Runner]:
    def add(run: Runner) -> Runner:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_blocks(sql, *needs)
        return run

    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, run=run: run(Tables(spark, sf_dir))) for name, run in QUERIES.items()}
