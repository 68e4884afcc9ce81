"""Settings from a TOML file, and the order in which command line, environment and file are asked."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from millrace.schemas import FIELDS

DEFAULT_FILE = Path("settings.toml")


class SettingsError(ValueError):
    """Settings that cannot be used."""


# The keys of a settings file, with the type and the default of each.
_KEYS = {
    "": {
        "linux_dir": ("path", None), "hashes_file": ("path", None), "outdir": ("path", None), "context_md": ("path", None), "evidence_dir": ("path", None),
        "workers": ("int", None), "force": ("bool", None), "max_tokens": ("int", None), "max_diff_chars": ("int", None), "start_index": ("int", None), "end_index": ("int", None),
    },
    "openai": {"api_key_file": ("path", None), "base_url": ("text", None), "model": ("text", None)},
    "hash_filter": {
        "source_file": ("path", None), "output_file": ("path", None), "audit_file": ("path", None), "include": ("texts", ()), "exclude": ("texts", ()),
        "fields": ("texts", ("subject", "body", "files")), "match": ("text", "any"), "case_sensitive": ("bool", False), "workers": ("int", None), "max_diff_chars": ("int", None),
    },
    "cve_source": {
        "inbox_dir": ("path", None), "output_file": ("path", None), "audit_file": ("path", None), "prefer_mainline": ("bool", True), "fallback_to_all": ("bool", False),
    },
}


class Settings(Mapping):
    """One table of settings, read by name: ``s.workers`` or ``s["workers"]``. Tables within it are settings, too."""

    def __init__(self, table: str = "", **given: Any):
        unknown = sorted(set(given) - set(_KEYS[table]) - (set(_KEYS) - {""} if not table else set()))
        if unknown:
            raise SettingsError(f"unknown settings in {table or 'the file'}: {', '.join(unknown)}")
        inner = {} if table else {t: Settings(t) for t in _KEYS if t}
        self._values = {name: default for name, (_, default) in _KEYS[table].items()} | inner | given

    def __getitem__(self, name: str) -> Any:
        return self._values[name]

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self._values[name]
        except KeyError as e:
            raise AttributeError(name) from e

    def __iter__(self):
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Settings) and self._values == other._values

    __hash__ = None


def _typed(name: str, kind: str, value: Any, base: Path) -> Any:
    """``value`` as the declared type of a key; an empty text means that it isn't set."""
    if kind == "path":
        if not isinstance(value, str):
            raise SettingsError(f"{name} must be a path")
        return (base / Path(value).expanduser()).resolve() if value else None
    if kind == "texts":
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            raise SettingsError(f"{name} must be a list of texts")
        return tuple(x.strip() for x in value if x.strip())
    wanted = {"int": int, "bool": bool, "text": str}[kind]
    if not isinstance(value, wanted) or (wanted is int and isinstance(value, bool)):
        raise SettingsError(f"{name} must be of type {kind}")
    return (value.strip() or None) if wanted is str else value


def _build(table: str, data: Mapping[str, Any], base: Path) -> Settings:
    Settings(table, **data)  # names only
    out: dict[str, Any] = {}
    for name, value in data.items():
        if not table and name in _KEYS:
            if not isinstance(value, dict):
                raise SettingsError(f"{name} must be a table")
            out[name] = _build(name, value, base)
        elif (typed := _typed(name, _KEYS[table][name][0], value, base)) is not None:
            out[name] = typed
    return Settings(table, **out)


def load_settings(path: str | Path, required: bool = False) -> Settings:
    """The settings of a file. A missing one is an error only if ``required``; relative paths stand beside it."""
    path = Path(path).expanduser().resolve()
    if not path.is_file():
        if required:
            raise SettingsError(f"no settings file {path}")
        return Settings()
    try:
        data = tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise SettingsError(f"{path} can't be read: {e}") from e
    found = _build("", data, path.parent)
    rules = found.hash_filter
    wrong = sorted(set(rules.fields) - set(FIELDS))
    if wrong or not rules.fields:
        raise SettingsError(f"hash_filter.fields must be some of {', '.join(FIELDS)}; wrong: {', '.join(wrong) or 'none given'}")
    if rules.match not in ("any", "all"):
        raise SettingsError("hash_filter.match must be any or all")
    return found


def first_given(*values: Any) -> Any:
    """The first value that is set: neither null nor an empty text."""
    return next((v for v in values if v is not None and v != ""), None)


def setting(cli: str | None, env_name: str, default: str, env: Mapping[str, str] | None = None) -> str:
    """Command line, else environment, else ``default``; stripped."""
    env = os.environ if env is None else env
    return str(first_given(cli, env.get(env_name), default) or "").strip()


def api_key(cli: str | None, key_file: str | Path, env: Mapping[str, str] | None = None) -> str:
    """The key from the command line, else the environment, else a file; none at all is an error."""
    env = os.environ if env is None else env
    for value in (cli, env.get("OPENAI_API_KEY")):
        if value and value.strip():
            return value.strip()
    try:
        value = Path(key_file).read_text(encoding="utf-8").strip()
    except (OSError, UnicodeDecodeError) as e:
        raise SettingsError(f"no key on the command line, in OPENAI_API_KEY or in {key_file}") from e
    if not value:
        raise SettingsError(f"{key_file} is empty")
    return value
