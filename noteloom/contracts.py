"""Control plane: errors, strict JSON, limits, gates and run identity. Small files on the driver, no Spark jobs."""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
import uuid
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path, PurePosixPath
from typing import Any
from unicodedata import normalize

# Exit codes by kind of failure.
SCHEMA, INTEGRITY, SECURITY, ENTITLEMENT, CROSS_CONTRACT, INTERNAL = 2, 3, 4, 5, 6, 70


class ContractError(Exception):
    """A breach of a contract: a code, a message that tells nothing of the data, where, and the exit code."""

    def __init__(self, code: str, message: str, location: str = "", exit_code: int = INTEGRITY):
        super().__init__(f"{code}: {message}" + (f" ({location})" if location else ""))
        self.code, self.message, self.location, self.exit_code = code, message, location, exit_code

    def report(self) -> dict[str, Any]:
        return {"code": self.code, "location": self.location, "message": self.message, "status": "failed"}


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found: dict[str, Any] = {}
    for key, value in pairs:
        if key in found:
            raise ContractError("JSON_INVALID", "A key is repeated.", exit_code=SCHEMA)
        found[key] = value
    return found


def _no_float(text: str) -> Any:
    raise ContractError("JSON_INVALID", "Floating-point numbers have no canonical form.", exit_code=SCHEMA)


def load_json(raw: bytes, location: str = "") -> Any:
    """Strict JSON: UTF-8, no repeated key, no floating-point number, no pointer to a large-file store."""
    if raw.startswith(b"version https://git-lfs.github.com/spec/"):
        raise ContractError("LFS_POINTER", "The file is a pointer, not its content.", location)
    try:
        return json.loads(raw.decode("utf-8"), object_pairs_hook=_unique, parse_float=_no_float, parse_constant=_no_float)
    except (UnicodeDecodeError, json.JSONDecodeError):
        raise ContractError("JSON_INVALID", "The file is no strict JSON.", location, SCHEMA) from None


def canonical_json(value: Any) -> bytes:
    """Keys in order, no blanks, UTF-8, no floating-point numbers."""

    def check(v: Any) -> None:
        if isinstance(v, float):
            _no_float("")
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, (list, tuple)) else ():
            check(x)

    check(value)
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8")


def digest(value: Any, domain: str) -> str:
    """SHA-256 of the canonical form, apart for each domain."""
    return hashlib.sha256(domain.encode() + b"\0" + canonical_json(value)).hexdigest()


def run_id(namespace: str, *parts: str) -> str:
    return str(uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, namespace), "\0".join(parts)))


def read_stable(path: str | Path, most_bytes: int = 10_000_000) -> bytes:
    """A regular file's bytes, not through a link, unchanged while read."""
    try:
        handle = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
    except OSError:
        raise ContractError("FILE_MISSING", "A file cannot be opened.", Path(path).name) from None
    try:
        before = os.fstat(handle)
        if not stat.S_ISREG(before.st_mode) or before.st_nlink != 1:
            raise ContractError("FILE_KIND", "Only regular files without other links are read.", Path(path).name, SECURITY)
        if before.st_size > most_bytes:
            raise ContractError("RESOURCE_LIMIT", "A file is larger than allowed.", Path(path).name, SECURITY)
        with os.fdopen(os.dup(handle), "rb") as source:
            raw = source.read(most_bytes + 1)
        after = os.fstat(handle)
    finally:
        os.close(handle)
    if (before.st_ino, before.st_size, before.st_mtime_ns) != (after.st_ino, after.st_size, after.st_mtime_ns):
        raise ContractError("FILE_CHANGED", "A file changed while it was read.", Path(path).name)
    return raw


def write_atomic(path: str | Path, raw: bytes) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    with beside.open("wb") as out:
        out.write(raw)
        out.flush()
        os.fsync(out.fileno())
    os.replace(beside, target)


def publish(staged: str | Path, target: str | Path) -> None:
    """Put a finished folder in the place of another; if that fails, the old one stands again."""
    staged, target = Path(staged), Path(target)
    backup = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    had = target.exists()
    if had:
        os.replace(target, backup)
    try:
        os.replace(staged, target)
    except OSError:
        if had:
            os.replace(backup, target)
        raise
    if had:
        import shutil

        shutil.rmtree(backup)


def relative_path(text: str) -> str:
    """A path within a bundle: NFC, POSIX, neither absolute nor upwards."""
    path = PurePosixPath(normalize("NFC", text))
    if path.is_absolute() or ".." in path.parts or "\\" in text or not path.parts or "\0" in text:
        raise ContractError("PATH_INVALID", "A path leaves its bundle.", exit_code=SECURITY)
    return str(path)


def is_absolute_uri(text: str) -> bool:
    return re.fullmatch(r"[A-Za-z][A-Za-z0-9+.\-]*:[^\s]+", text) is not None


@dataclass(frozen=True)
class MiningLimits:
    """Bounds of mining; the values are the reference limits, larger corpora state their own."""

    min_ngram_tokens: int = 1
    max_ngram_tokens: int = 4
    min_document_frequency: int = 1
    max_unique_phrases: int = 1_000_000
    max_tokens_per_document: int = 250_000
    max_ngrams_per_document: int = 1_000_000

    def __post_init__(self) -> None:
        if not 1 <= self.min_ngram_tokens <= self.max_ngram_tokens <= 8 or self.min_document_frequency < 1:
            raise ContractError("CONFIG_INVALID", "Mining limits are out of range.", "mining", SCHEMA)


@dataclass(frozen=True)
class Config:
    """An analysis configuration, checked against the snapshot and the releases it is used with."""

    languages: tuple[str, ...]
    note_types: tuple[str, ...]
    terminologies: tuple[tuple[str, str], ...]
    mining: MiningLimits = field(default_factory=MiningLimits)

    @staticmethod
    def read(path: str | Path) -> Config:
        raw = load_json(read_stable(path), Path(path).name)
        try:
            return Config(tuple(raw["languages"]), tuple(raw["note_types"]), tuple((t["system_uri"], t["release_id"]) for t in raw["terminologies"]), MiningLimits(**raw.get("mining", {})))
        except (KeyError, TypeError):
            raise ContractError("CONFIG_INVALID", "The configuration lacks a field or has an unknown one.", Path(path).name, SCHEMA) from None

    def check(self, languages: set[str], note_types: set[str], releases: set[tuple[str, str]]) -> None:
        """The corpus must use configured languages and note types only, and the releases must be exactly the configured ones."""
        if languages - set(self.languages):
            raise ContractError("CONFIG_MISMATCH", "The corpus has languages that aren't configured.", "languages", CROSS_CONTRACT)
        if note_types - set(self.note_types):
            raise ContractError("CONFIG_MISMATCH", "The corpus has note types that aren't configured.", "note_types", CROSS_CONTRACT)
        if releases != set(self.terminologies):
            raise ContractError("CONFIG_MISMATCH", "The releases are not the configured ones.", "terminologies", CROSS_CONTRACT)


def check_attestation(path: str | Path) -> bool:
    """A data-use attestation must approve the run; returns whether lexical output is approved too."""
    raw = load_json(read_stable(path), "attestation")
    if not isinstance(raw, dict) or raw.get("approved") is not True or not raw.get("approval_refs"):
        raise ContractError("ATTESTATION_INVALID", "The attestation does not approve the run.", "attestation", ENTITLEMENT)
    return raw.get("lexical_output_approved") is True


def check_entitlement(path: str | Path, systems: set[str], today: date | None = None) -> None:
    """An entitlement must name every system and be neither early nor past its review."""
    raw = load_json(read_stable(path), "entitlement")
    now = today or date.today()
    try:
        asserted, due = date.fromisoformat(raw["asserted_on"]), date.fromisoformat(raw["review_due_on"])
        named = set(raw["terminologies"])
    except (KeyError, TypeError, ValueError):
        raise ContractError("ENTITLEMENT_INVALID", "The entitlement is incomplete.", "entitlement", ENTITLEMENT) from None
    if not asserted <= now <= due or systems - named:
        raise ContractError("ENTITLEMENT_INVALID", "The entitlement does not cover the run.", "entitlement", ENTITLEMENT)
