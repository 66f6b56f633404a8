"""Operators by name: what a service or a notebook calls when it does not import them.

An operator is any public function of ``lakeloom.operators`` that takes and returns DataFrames;
its id is ``module.function``.  Inputs are DataFrames by parameter name; JSON stays at the edge.
"""

from __future__ import annotations

import importlib
import inspect
import json
import pkgutil
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lakeloom import operators as _operators
from lakeloom.plans import registry


class UnknownOperator(KeyError):
    """No operator or kernel has this id."""


class BadRequest(ValueError):
    """The inputs or parameters do not fit the operator."""


@dataclass(frozen=True)
class Operator:
    """An operator with the names of its input tables and its parameters with defaults."""

    name: str
    call: Callable[..., DataFrame]
    inputs: tuple[str, ...]
    optional: tuple[str, ...]
    params: Mapping[str, object]

    @property
    def doc(self) -> str:
        return inspect.getdoc(self.call) or ""


def _describe(module: str, fn: Callable) -> Operator | None:
    signature = inspect.signature(fn)
    if "DataFrame" not in str(signature.return_annotation):
        return None
    tables = [p for p in signature.parameters.values() if "DataFrame" in str(p.annotation)]
    if not tables:
        return None
    names = {p.name for p in tables}
    params = {p.name: p.default for p in signature.parameters.values() if p.name not in names}
    required = tuple(p.name for p in tables if p.default is inspect.Parameter.empty)
    return Operator(f"{module}.{fn.__name__}", fn, required, tuple(names - set(required)), params)


def operators() -> dict[str, Operator]:
    """All operators by id."""
    out = {}
    for info in pkgutil.iter_modules(_operators.__path__):
        module = importlib.import_module(f"{_operators.__name__}.{info.name}")
        for name, fn in vars(module).items():
            if inspect.isfunction(fn) and fn.__module__ == module.__name__ and not name.startswith("_"):
                found = _describe(info.name, fn)
                if found:
                    out[found.name] = found
    return out


def find(name: str) -> Operator:
    known = operators()
    if name not in known:
        raise UnknownOperator(name)
    return known[name]


def run(name: str, inputs: Mapping[str, DataFrame], **params) -> DataFrame:
    """The operator's result over DataFrames given by input name."""
    operator = find(name)
    missing = set(operator.inputs) - set(inputs)
    strange = set(inputs) - set(operator.inputs) - set(operator.optional)
    if missing or strange:
        raise BadRequest(f"{name}: inputs {sorted(operator.inputs)}, missing {sorted(missing)}, unknown {sorted(strange)}")
    unknown = set(params) - set(operator.params)
    unset = {k for k, v in operator.params.items() if v is inspect.Parameter.empty} - set(params)
    if unknown or unset:
        raise BadRequest(f"{name}: parameters {sorted(operator.params)}, unset {sorted(unset)}, unknown {sorted(unknown)}")
    return operator.call(**inputs, **params)


def run_kernel(spark: SparkSession, kernel: str, sf_dir: str) -> dict[str, DataFrame]:
    """The results of all registered queries of a kernel over the tables of a folder."""
    registry.queries()
    found = {e.name: e.run(spark, sf_dir) for e in registry.ENTRIES.values() if e.kernel == kernel}
    if not found:
        raise UnknownOperator(kernel)
    return found


def run_json(spark: SparkSession, name: str, body: str | bytes) -> str:
    """One request with its tables in it: {"inputs": {table: [record, ...]}, "params": {...}} gives a
    JSON array of records.  For requests that fit the driver, as the body does already."""
    try:
        request = json.loads(body)
        tables = dict(request["inputs"])
        params = dict(request.get("params", {}))
    except (ValueError, KeyError, TypeError) as e:
        raise BadRequest(f"{name}: {e}") from e
    inputs = {}
    for table, records in tables.items():
        if not isinstance(records, list) or not records:
            raise BadRequest(f"{name}: {table} must be an array of one record or more")
        inputs[table] = spark.createDataFrame(records)
    return "[" + ",".join(run(name, inputs, **params).toJSON().collect()) + "]"
