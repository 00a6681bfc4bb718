"""Typed settings from a file and the environment, and the driver-side tables that come as files: aliases and a formula book.

Files may be TOML or JSON, and YAML where its parser is installed. A setting that nobody knows, or of another type, is an
error, as is a vector size that the stored vectors do not have.
"""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "EVSPARK_"


class SettingsError(ValueError):
    """A setting is unknown, of the wrong type or at odds with what is stored."""


@dataclass(frozen=True)
class Ingest:
    min_page_chars: int = 200


@dataclass(frozen=True)
class Routing:
    top_k_filings: int = 4


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 20
    neighbour_distance: int = 1
    token_budget: int = 42_000
    use_reranker: bool = True
    rerank_top_n: int = 15
    vector_size: int = 1024


@dataclass(frozen=True)
class Verification:
    enabled_gates: tuple[str, ...] = ("G1", "G1b", "G2", "G3", "G4", "G5", "G6", "G7")
    verifiers: bool = True
    adversarial: bool = True


@dataclass(frozen=True)
class Evaluation:
    numeric_tolerance: float = 0.005
    map_min_jaccard: float = 0.35
    location_containment: float = 0.6
    page_slack: int = 1
    price_in: float | None = None
    price_out: float | None = None


@dataclass(frozen=True)
class Settings:
    ingest: Ingest = field(default_factory=Ingest)
    routing: Routing = field(default_factory=Routing)
    retrieval: Retrieval = field(default_factory=Retrieval)
    verification: Verification = field(default_factory=Verification)
    evaluation: Evaluation = field(default_factory=Evaluation)


def read_table(path: str) -> dict[str, Any]:
    """The content of a TOML, JSON or YAML file on the driver."""
    with open(path, "rb") as file:
        data = file.read()
    if path.endswith(".toml"):
        return tomllib.loads(data.decode())
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as error:
            raise SettingsError("YAML files need a YAML parser; TOML and JSON don't") from error
        return yaml.safe_load(data) or {}
    return json.loads(data)


def _fitted(value: Any, kind: Any, name: str) -> Any:
    """``value`` as the type of a field; text, as the environment has it, is read."""
    optional = "None" in str(kind)
    if optional and value in (None, ""):
        return None
    base = next(t for t in (tuple, bool, int, float, str) if t.__name__ in str(kind))
    if base is tuple:
        items = value.split(",") if isinstance(value, str) else value
        return tuple(str(x).strip() for x in items if str(x).strip())
    if base is bool:
        if isinstance(value, str) and value.lower() in ("true", "false", "1", "0"):
            return value.lower() in ("true", "1")
        if isinstance(value, bool):
            return value
    elif not isinstance(value, bool) and isinstance(value, (int, float, str)):
        try:
            number = base(value)
        except ValueError:
            number = None
        if number is not None and (base is not int or not isinstance(value, float)):
            return number
    raise SettingsError(f"{name}: {value!r} is no {base.__name__}")


def _build(kind: type, given: dict[str, Any], environment: dict[str, str], path: str) -> Any:
    hints = get_type_hints(kind)
    unknown = set(given) - set(hints)
    if unknown:
        raise SettingsError(f"unknown settings: {', '.join(sorted(path + u for u in unknown))}")
    made = {}
    for f in fields(kind):
        name = f"{path}{f.name}"
        if is_dataclass(hints[f.name]):
            made[f.name] = _build(hints[f.name], given.get(f.name) or {}, environment, name + ".")
            continue
        variable = PREFIX + name.replace(".", "_").upper()
        if variable in environment:
            made[f.name] = _fitted(environment[variable], hints[f.name], name)
        elif f.name in given:
            made[f.name] = _fitted(given[f.name], hints[f.name], name)
    return kind(**made)


def load_settings(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Defaults, then the file, then variables such as EVSPARK_RETRIEVAL_TOP_K."""
    return _build(Settings, read_table(path) if path else {}, dict(os.environ) if environment is None else environment, "")


def check_vectors(settings: Settings, vectors: DataFrame, embedding: str = "embedding") -> None:
    """Raises if stored vectors have another size than the settings say; nulls don't count."""
    other = vectors.filter(F.col(embedding).isNotNull() & (F.size(embedding) != settings.retrieval.vector_size)).select(F.size(embedding)).first()
    if other is not None:
        raise SettingsError(f"a stored vector has {other[0]} components, the settings say {settings.retrieval.vector_size}")


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(company_slug, alias) from a file of slugs with lists of aliases."""
    from evspark.sources.filings import read_aliases

    return read_aliases(spark, {slug: names or [] for slug, names in read_table(path).items()})


def load_book(path: str) -> dict[str, tuple[tuple[str, ...], str, str, int, bool]]:
    """Metrics from a file, in the form of ``metrics.METRICS``; every formula is compiled, so that a bad one is an error here."""
    from evspark.operators.metrics import compile_formula

    book = {}
    for name, m in read_table(path).items():
        compile_formula(m["formula"])
        book[name] = (tuple(str(a).lower() for a in m.get("aliases", ())), m["formula"], m.get("unit", "ratio"), int(m.get("decimals", 2)), bool(m.get("percent", False)))
    return book


def status_listing(filings: DataFrame, company: str | None = None, status: str | None = None) -> DataFrame:
    """Filings with their status and progress, of one company or status if asked for, newest year first."""
    rows = filings
    if company is not None:
        rows = rows.filter(F.col("company_slug") == company.upper())
    if status is not None:
        rows = rows.filter(F.col("ingest_status") == status)
    return rows.select("doc_id", "company_slug", "form_type", "period_label", "ingest_status", "ingest_progress", "error", "fiscal_year").orderBy(F.desc_nulls_last("fiscal_year"), "doc_id").drop("fiscal_year")
