"""Ingestion assistant: column profiles, mapping proposals, guarded language-model calls and value lookups."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any, Protocol

import pydantic
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weldrow.config import ColumnMapping, LLMConfig, SchemaMapping
from weldrow.functions import text as T
from weldrow.functions.constants import ORG_ALIASES, TITLE_TAXONOMY
from weldrow.functions.udf import cleaned, token_sort_ratio
from weldrow.profiles import EntityProfile
from weldrow.sources.knowledge import resolve_lookup, usable_rows, with_asset_columns

SHAPE_SAMPLE, SHAPE_LEAST, SHAPE_SHARE = 200, 5, 0.9


def profile_columns(df: DataFrame) -> DataFrame:
    """``column_name, n_distinct, share_missing`` in one aggregate."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.countDistinct(c).alias("n_distinct"), F.avg(F.col(c).isNull().cast("int")).alias("share_missing")) for c in df.columns]
    return df.agg(F.array(*parts).alias("p")).select(F.inline("p"))


def shape_tests() -> dict[str, Callable]:
    """Shapes in the order in which they are tried."""
    return {
        "npi": lambda c: T.npi_reason(c).isNull(),
        "ein": lambda c: c.rlike(r"^\d{2}-?\d{7}$") & T.ein_reason(c).isNull(),
        "email": lambda c: c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"),
        "phone": lambda c: c.rlike(r"^[\s()+.\-0-9x]+$") & T.normalize_phone(c).isNotNull(),
        "zip": lambda c: c.rlike(r"^\d{5}(-?\d{4})?$"),
    }


def detect_shapes(df: DataFrame, least_share: float = SHAPE_SHARE) -> dict[str, tuple[str, float]]:
    """For each column the first shape that enough of its first values have; one job over a sample of bounded size."""
    tests = shape_tests()
    sample = df.limit(SHAPE_SAMPLE)
    aggs = [F.count(c).alias(f"{c}|n") for c in df.columns] + [F.avg(F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(t(F.col(f"`{c}`")), F.lit(False)).cast("int"))).alias(f"{c}|{s}") for c in df.columns for s, t in tests.items()]
    got = sample.agg(*aggs).first().asDict()
    out = {}
    for c in df.columns:
        if (got[f"{c}|n"] or 0) >= SHAPE_LEAST:
            hit = next(((s, got[f"{c}|{s}"]) for s in tests if (got[f"{c}|{s}"] or 0) >= least_share), None)
            if hit:
                out[c] = hit
    return out


def header_key(header: str) -> str:
    return re.sub("[^a-z0-9]+", "_", header.lower()).strip("_")


def prematch(raw: DataFrame, profile: EntityProfile, examples: Sequence[SchemaMapping] = ()) -> tuple[dict[str, ColumnMapping], list[str]]:
    """(sure entries by column, columns left): equal header, a header approved before, or the values' shape. A target is used once."""
    canonical, found, used = profile.canonical_columns(), {}, set()
    shapes = detect_shapes(raw)
    before = {header_key(c): t for m in examples for c, t in m.as_dict().items()}
    by_shape = {"npi": "npi", "ein": "ein", "email": "email", "phone": "phone", "zip": "address_zip"}

    def propose(c: str) -> ColumnMapping | None:
        if header_key(c) in canonical:
            return ColumnMapping(source_column=c, target=header_key(c), confidence=0.99, rationale="header is a canonical column")
        if header_key(c) in before:
            return ColumnMapping(source_column=c, target=before[header_key(c)], confidence=0.97, rationale="approved for this header before")
        if c in shapes and by_shape[shapes[c][0]] in canonical:
            return ColumnMapping(source_column=c, target=by_shape[shapes[c][0]], confidence=round(0.8 + 0.15 * shapes[c][1], 3), rationale=f"values look like {shapes[c][0]}")
        return None

    for entry in sorted((e for c in raw.columns if (e := propose(c))), key=lambda e: -e.confidence):
        if entry.target not in used:
            used.add(entry.target)
            found[entry.source_column] = entry
    return found, [c for c in raw.columns if c not in found]


def mask_text(value: str) -> str:
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", value)))


Redactor = Callable[[str, str | None], str | None]


def default_redactor(columns: Sequence[str]) -> Redactor:
    """Values of these columns leave only as their shape."""
    return lambda column, value: mask_text(value) if value is not None and column in columns else value


class LLMRequest(pydantic.BaseModel):
    task: str
    system: str
    payload: dict[str, Any]
    temperature: float = 0.0
    seed: int = 0

    def prompt_hash(self) -> str:
        return hashlib.sha256(json.dumps([self.task, self.system, self.payload], sort_keys=True, default=str).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class CallRecord:
    timestamp: str
    provider: str
    model: str
    task: str
    prompt_hash: str
    response: str

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


class CallLog:
    """One JSON line a call, below a folder."""

    def __init__(self, folder: str | Path) -> None:
        self.path = Path(folder) / "llm_calls.jsonl"

    def write(self, record: CallRecord, **context: Any) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(record.as_dict() | context, sort_keys=True, default=str) + "\n")

    def read(self) -> list[dict]:
        return [json.loads(x) for x in self.path.read_text(encoding="utf-8").splitlines()] if self.path.exists() else []


class ProposedColumn(pydantic.BaseModel):
    source_column: str
    target: str | None = None
    confidence: float = pydantic.Field(0.0, ge=0, le=1)
    rationale: str = ""


class Proposal(pydantic.BaseModel):
    columns: list[ProposedColumn] = []


class ValueMapping(pydantic.BaseModel):
    value: str
    target: str | None = None
    confidence: float = pydantic.Field(0.0, ge=0, le=1)


class ValueBatch(pydantic.BaseModel):
    mappings: list[ValueMapping] = []


class IdentifierCandidate(pydantic.BaseModel):
    value: str
    kind: str


class Extraction(pydantic.BaseModel):
    candidates: list[IdentifierCandidate] = []


class LLMClient(Protocol):
    def complete(self, request: LLMRequest, response: type[pydantic.BaseModel]) -> tuple[Any, CallRecord]: ...


def _record(provider: str, model: str, request: LLMRequest, answer: pydantic.BaseModel) -> CallRecord:
    return CallRecord(datetime.now(UTC).isoformat(timespec="seconds"), provider, model, request.task, request.prompt_hash(), answer.model_dump_json())


def _mock_mapping(payload: dict) -> dict:
    words = {"fname": "name_first", "first": "name_first", "given": "name_first", "lname": "name_last", "last": "name_last", "surname": "name_last", "employer": "org", "practice": "org", "organization": "org", "org": "org", "street": "address_street", "addr": "address_street", "line1": "address_street", "city": "address_city", "state": "address_state", "zip": "address_zip", "postal": "address_zip", "phone": "phone", "tel": "phone", "mail": "email", "title": "title", "specialty": "title", "role": "title", "tax": "ein", "ein": "ein", "npi": "npi", "name": "name"}
    out = []
    for c in payload["columns"]:
        tokens = header_key(c["name"]).split("_")
        target = next((t for w, t in words.items() if any(w in x for x in tokens) and t in payload["targets"]), None)
        out.append({"source_column": c["name"], "target": target, "confidence": 0.7 if target else 0.0, "rationale": "header words"})
    return {"columns": out}


def _closest(value: str, choices: Mapping[str, str]) -> tuple[str | None, float]:
    best = max(choices, key=lambda k: (token_sort_ratio(cleaned(value), k), k), default=None)
    score = token_sort_ratio(cleaned(value), best) / 100 if best else 0.0
    return (choices[best], round(score, 3)) if score >= 0.8 else (None, round(score, 3))


def _mock_titles(payload: dict) -> dict:
    return {"mappings": [dict(zip(("value", "target", "confidence"), (v, *_closest(v, {k: t for k, t in TITLE_TAXONOMY.items() if t in payload["allowed"]})), strict=True)) for v in payload["values"]]}


def _mock_orgs(payload: dict) -> dict:
    out = []
    for v in payload["values"]:
        words = cleaned(v).split()
        long = " ".join(ORG_ALIASES.get(w, w) for w in words if ORG_ALIASES.get(w, w))
        out.append({"value": v, "target": long or None, "confidence": 0.9 if long != " ".join(words) else 0.5})
    return {"mappings": out}


def _mock_identifiers(payload: dict) -> dict:
    npis, eins = re.findall(r"\b\d{10}\b", payload["text"]), re.findall(r"\b\d{2}-\d{7}\b", payload["text"])
    return {"candidates": [{"value": v, "kind": "npi"} for v in npis] + [{"value": v, "kind": "ein"} for v in eins]}


class MockClient:
    """Answers by rules, or from a script; the same request always gets the same answer."""

    handlers: dict[str, Callable[[dict], dict]] = {"schema_mapping": _mock_mapping, "titles": _mock_titles, "org_aliases": _mock_orgs, "identifiers": _mock_identifiers}

    def __init__(self, handlers: Mapping[str, Callable[[dict], dict]] | None = None, script: Sequence[pydantic.BaseModel] | None = None) -> None:
        self.handlers = {**type(self).handlers, **(handlers or {})}
        self.script = list(script) if script is not None else None

    def complete(self, request, response):
        if self.script is not None:
            answer = response.model_validate(self.script.pop(0).model_dump())
        elif request.task in self.handlers:
            answer = response.model_validate(self.handlers[request.task](request.payload))
        else:
            raise KeyError(f"no handler for '{request.task}'")
        return answer, _record("mock", "rules", request, answer)


class ChatClient:
    """Any chat-completion client object with JSON answers; key and address come from its own environment."""

    def __init__(self, client: Any, model: str, provider: str = "azure") -> None:
        self.client, self.model, self.provider = client, model, provider

    def complete(self, request, response):
        told = [{"role": "system", "content": request.system}, {"role": "user", "content": json.dumps(request.payload, sort_keys=True, default=str)}]
        got = self.client.chat.completions.create(model=self.model, messages=told, temperature=request.temperature, seed=request.seed, response_format={"type": "json_object"})
        answer = response.model_validate_json(got.choices[0].message.content)
        return answer, _record(self.provider, self.model, request, answer)


def make_client(config: LLMConfig, chat: Any = None, model: str = "") -> LLMClient:
    if config.provider == "mock":
        return MockClient()
    if chat is None:
        raise ValueError("a chat client object is needed for this provider")
    return ChatClient(chat, model, config.provider)


def build_payload(raw: DataFrame, columns: Sequence[str], profile: EntityProfile, used: set[str], examples: Sequence[SchemaMapping], sample_rows: int, redact: Redactor) -> dict[str, Any]:
    """Column statistics and a redacted sample of bounded size."""
    stats = {r["column_name"]: r for r in profile_columns(raw.select(*columns)).collect()} if columns else {}
    rows = raw.select(*columns).limit(sample_rows).collect() if columns and sample_rows else []
    return {
        "columns": [{"name": c, "n_distinct": stats[c]["n_distinct"], "share_missing": round(stats[c]["share_missing"] or 0.0, 4), "sample": [redact(c, r[c]) for r in rows]} for c in columns],
        "targets": {t: told for t, told in profile.mapping_targets().items() if t not in used},
        "examples": [m.as_dict() for m in examples],
    }


def propose_mapping(raw: DataFrame, source: str, profile: EntityProfile, client: LLMClient, record_id_column: str | None = None, examples: Sequence[SchemaMapping] = (), sample_rows: int = 20, redact_columns: Sequence[str] = (), redactor: Redactor | None = None, log: CallLog | None = None) -> SchemaMapping:
    """A proposed mapping: sure entries first, the client for the rest. Unknown targets are ignored, the surer claim gets a target."""
    data = raw.drop(record_id_column) if record_id_column else raw
    found, left = prematch(data, profile, examples)
    provenance: dict[str, Any] = {"prematched": len(found)}
    if left:
        used = {e.target for e in found.values()}
        request = LLMRequest(task="schema_mapping", system="Map source columns to the given targets; answer with JSON.", payload=build_payload(data, left, profile, used, examples, sample_rows, redactor or default_redactor(redact_columns)))
        answer, record = client.complete(request, Proposal)
        if log:
            log.write(record, source=source)
        provenance["prompt_hash"] = record.prompt_hash
        known = profile.canonical_columns()
        for p in sorted(answer.columns, key=lambda p: -p.confidence):
            if p.source_column in left and p.target in known and p.target not in used:
                used.add(p.target)
                found[p.source_column] = ColumnMapping(source_column=p.source_column, target=p.target, confidence=p.confidence, rationale=p.rationale)
    order = [c for c in data.columns if c in found]
    return SchemaMapping(source=source, profile=profile.name, record_id_column=record_id_column, columns=[found[c] for c in order], unmapped=[c for c in data.columns if c not in found], provenance=provenance)


def value_key(value: str, kind: str) -> str:
    clean = cleaned(value)
    if kind == "org":
        from weldrow.functions.text import _SUFFIX

        clean = " ".join(re.sub(_SUFFIX, "", " " + clean).split()) or clean
    return clean


class LookupCache:
    """Reviewed value targets: a small table in the knowledge base, held on the driver while values are standardised."""

    def __init__(self, kb, table: str, engagement: str, promoted_only: bool = True) -> None:
        self.kb, self.table, self.engagement, self.promoted_only = kb, table, engagement, promoted_only
        self.new: list[dict[str, str]] = []

    def usable(self) -> DataFrame | None:
        rows = self.kb.read(self.table)
        return None if rows is None else usable_rows(rows, self.engagement, self.promoted_only)

    def lookup(self) -> dict[str, str]:
        rows = self.usable()
        out = {} if rows is None else {r["value"]: r["target"] for r in resolve_lookup(rows, "value", self.engagement).collect()}
        return out | {r["value"]: r["target"] for r in self.new}

    def add(self, items: Iterable[tuple[str, str, float]], method: str, reviewer: str = "") -> int:
        rows = [{"value": v, "target": t, "confidence": f"{c:.3f}", "method": method, "reviewer": reviewer} for v, t, c in items]
        self.new += rows
        return len(rows)

    def save(self) -> int:
        if not self.new:
            return 0
        schema = "value string, target string, confidence string, method string, reviewer string"
        rows = with_asset_columns(self.kb.spark.createDataFrame([tuple(r.values()) for r in self.new], schema), self.engagement)
        self.new = []
        return self.kb.append(self.table, rows)


LOOKUPS = {"taxonomy": "lookup_titles", "aliases": "lookup_org_aliases"}


def lookup_dependencies(kb, config) -> dict[str, dict[str, str]]:
    """What the field types of titles and organisations take from the knowledge base's usable lookups."""
    return {d: LookupCache(kb, t, config.engagement.id, config.knowledge_base.use_promoted_only).lookup() for d, t in LOOKUPS.items()}


def standardize_values(values: DataFrame, kind: str, client: LLMClient, cache: LookupCache, batch_size: int = 50, allowed: Iterable[str] | None = None, log: CallLog | None = None) -> dict[str, Any]:
    """Distinct values of a one-column frame: from the cache, from built-in tables, else from the client in batches.

    Answers are refused for values that were not asked, targets that are not allowed, and targets that look like
    identifiers. Only distinct keys reach the driver.
    """
    builtin = TITLE_TAXONOMY if kind == "title" else {}
    allowed = set(allowed if allowed is not None else TITLE_TAXONOMY.values()) if kind == "title" else None
    column = F.col(values.columns[0])
    key = T.value_key(column, kind)
    asked = {r[0] for r in values.where(column.isNotNull()).select(key).distinct().toLocalIterator() if r[0]}
    known = cache.lookup()
    out: dict[str, Any] = {"distinct": len(asked), "cached": len(asked & set(known)), "builtin": 0, "added": 0, "rejected": []}
    rest = asked - set(known)
    out["builtin"] = len(rest & set(builtin))
    rest = sorted(rest - set(builtin))
    for i in range(0, len(rest), batch_size):
        batch = rest[i : i + batch_size]
        request = LLMRequest(task="titles" if kind == "title" else "org_aliases", system="Give each value its standard form; answer with JSON.", payload={"values": batch} | ({"allowed": sorted(allowed)} if allowed is not None else {}))
        answer, record = client.complete(request, ValueBatch)
        if log:
            log.write(record, kind=kind)
        good = []
        for m in answer.mappings:
            why = "unknown_value" if m.value not in batch else "no_target" if not m.target else "not_allowed" if allowed is not None and m.target not in allowed else "identifier_like" if re.search(r"\d{7,}", m.target) else None
            if why:
                out["rejected"].append({"value": m.value, "target": m.target, "reason": why})
            else:
                good.append((m.value, m.target, m.confidence))
        out["added"] += cache.add(good, "llm")
    return out


def check_identifier(value: str, kind: str, source: str) -> str | None:
    """Why an extracted identifier is refused, else None."""
    digits = re.sub("[^0-9]", "", value)
    if value not in source:
        return "not_in_source"
    if kind == "npi":
        if len(digits) != 10 or digits[0] not in "12":
            return "not_10_digits" if len(digits) != 10 else "bad_leading_digit"
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed("80840" + digits))))
        return None if total % 10 == 0 else "luhn_failed"
    return None if len(digits) == 9 else "not_9_digits"


def extract_identifiers(text: str, client: LLMClient, log: CallLog | None = None) -> list[dict[str, str]]:
    """Candidates that stand in the text and are valid."""
    answer, record = client.complete(LLMRequest(task="identifiers", system="List identifiers in the text; answer with JSON.", payload={"text": text}), Extraction)
    if log:
        log.write(record)
    return [c.model_dump() for c in answer.candidates if check_identifier(c.value, c.kind, text) is None]
