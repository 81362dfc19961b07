"""The row of one extracted file, as plain tuples and as a Spark schema."""

from __future__ import annotations

from typing import NamedTuple

SCHEMA = (
    "file_id bigint, repo string, file_path string, language string, sha256 string, file_size_bytes bigint, line_count bigint, "
    "symbols array<struct<name:string,kind:string,line_start:int,line_end:int,signature:string,visibility:string,parent:string,docstring:string,"
    "parameters:array<struct<name:string,type:string,default:string>>,return_type:string>>, "
    "imports array<struct<module:string,names:array<string>,alias:string,line:int,kind:string>>, exports array<struct<name:string,kind:string,line:int>>, "
    "call_edges array<struct<caller:string,callee:string,line:int,confidence:double>>, rationale_comments array<struct<tag:string,text:string,line:int,context:string>>, extraction_errors array<string>"
)


class Symbol(NamedTuple):
    name: str
    kind: str
    line_start: int
    line_end: int
    signature: str
    visibility: str
    parent: str | None = None
    docstring: str | None = None
    parameters: list = []
    return_type: str | None = None


class Import(NamedTuple):
    module: str
    names: list[str]
    alias: str | None
    line: int
    kind: str


class Export(NamedTuple):
    name: str
    kind: str
    line: int


class Call(NamedTuple):
    caller: str
    callee: str
    line: int
    confidence: float


class Extraction(NamedTuple):
    symbols: list[Symbol]
    imports: list[Import]
    exports: list[Export]
    calls: list[Call]
    errors: list[str]
