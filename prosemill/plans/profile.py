"""Versioned profiles: a manifest, rules and a dictionary, loaded on the driver, checked whole and used as small literals."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

BUNDLED = Path(__file__).resolve().parents[1] / "profiles"
#: Kinds of documents, those of profiles, statuses, enforcements and severities.
KINDS = ["agent-instruction", "code-comment", "decision", "description", "incident", "pr", "procedure", "reference", "status-update"]
PROFILE_KINDS = {"description", "procedure", "pr", "code-comment"}
STATUSES, ENFORCEMENTS, SEVERITIES = {"preferred", "allowed", "discouraged", "observed"}, {"enforced", "candidate", "advisory", "disabled"}, {"error", "warning", "info"}
#: The rules and the parameters they take.
PARAMETERS = {
    "CORE.SENTENCE_LENGTH": ["description_max_words", "procedure_max_words", "pr_max_words"], "CORE.DENSE_PARAGRAPH": ["max_sentences", "max_words"],
    "CORE.NOUN_STACK": ["min_stack_length"], "CORE.CORPUS_NOVELTY": ["min_repetition"],
}
RULES = ["CORE." + r for r in (
    "SENTENCE_LENGTH DENSE_PARAGRAPH NOUN_STACK GERUND_OPENER TERM_DISCOURAGED CONTRACTION BANNED_MODAL LATIN_ABBREV UNEXPANDED_ABBREV TIME_ANCHOR "
    "EXCLAMATION ORDINAL_NUMERAL PERCENT_STYLE AMBIGUOUS_DATE HEADING_CASE GERUND_HEADING HEADING_SKIP HEADING_PUNCTUATION SINGLE_ITEM_LIST "
    "SEQUENTIAL_BULLET TERM_CASE TERM_UNKNOWN TERM_CONSISTENCY PROCEDURE_MULTI_ACTION CORPUS_NOVELTY"
).split()]


class ProfileError(ValueError):
    """A profile or configuration with faults, all of them listed."""


def fold(text: str) -> str:
    """Lower case character by character."""
    return "".join(c.lower()[:1] if len(c.lower()) > 1 else c.lower() for c in text)


@dataclass
class Profile:
    manifest: dict
    rules: dict
    dictionary: dict
    sha256: str = ""
    source: str = ""
    #: The project's own terms: term, parts_of_speech, definition, override, reason.
    terms: list[dict] = field(default_factory=list)

    def rule(self, rule_id: str) -> dict:
        return next((r for r in self.rules["rules"] if r["id"] == rule_id), {})

    def parameter(self, rule_id: str, name: str, default: int = 0) -> int:
        value = (self.rule(rule_id).get("parameters") or {}).get(name)
        return value if isinstance(value, int) and not isinstance(value, bool) and value > 0 else default

    def policy(self, rule_id: str, enforcement: str = "candidate", severity: str = "info") -> tuple[str, str]:
        r = self.rule(rule_id)
        return r.get("enforcement") or enforcement, r.get("severity") or severity

    def words(self, name: str) -> list[str]:
        return sorted({fold(w) for w in self.dictionary.get("word_classes", {}).get(name, [])})

    def entry(self, term: str) -> dict | None:
        return next((e for e in self.dictionary["entries"] if fold(e["term"]) == fold(term)), None)

    def enabled(self) -> list[str]:
        """Ids of the rules that run, in the profile's order; enforcement doesn't count."""
        return [r["id"] for r in self.rules["rules"] if r.get("enabled") and r["id"] in RULES]

    def resolve_term(self, term: str) -> dict | None:
        """A term's entry: the project's own if it overrides with a reason (preferred) or doesn't meet a discouraged one
        (allowed), else the dictionary's; None where the project's is in conflict."""
        own, known = next((t for t in self.terms if fold(t["term"]) == fold(term)), None), self.entry(term)
        if own is None:
            return known
        if own.get("override") and own.get("reason"):
            return {"term": own["term"], "status": "preferred", "parts_of_speech": own.get("parts_of_speech", [])}
        if known and known["status"] == "discouraged":
            return None
        return {"term": own["term"], "status": "allowed", "parts_of_speech": own.get("parts_of_speech", [])}


def faults(manifest: dict, rules: dict, dictionary: dict) -> list[str]:
    """Everything that is wrong with a bundle's contents."""
    out = []
    if manifest.get("format_version") not in (1, 2):
        out.append("manifest: unsupported format_version")
    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", manifest.get("id", "")):
        out.append("manifest: invalid id")
    if not re.fullmatch(r"\d+\.\d+\.\d+", manifest.get("version", "")):
        out.append("manifest: invalid version")
    out += [f"manifest: missing {k}" for k in ("language", "license", "kinds", "provenance", "payloads") if not manifest.get(k)]
    if manifest.get("language") not in (None, "", "en"):
        out.append("manifest: unsupported language")
    out += [f"manifest: unsupported kind {k}" for k in manifest.get("kinds", []) if k not in PROFILE_KINDS]
    if rules.get("format_version") != 1:
        out.append("rules: unsupported format_version")
    seen = set()
    for i, r in enumerate(rules.get("rules", [])):
        rule, given = r.get("id", ""), r.get("parameters") or {}
        if rule not in RULES:
            out.append(f"rules[{i}]: unknown rule {rule!r}")
        if rule in seen:
            out.append(f"rules[{i}]: duplicate rule {rule!r}")
        seen.add(rule)
        if r.get("version") != 1:
            out.append(f"rules[{i}]: unsupported version")
        if r.get("enforcement") not in ENFORCEMENTS:
            out.append(f"rules[{i}]: invalid enforcement")
        if r.get("severity") not in SEVERITIES:
            out.append(f"rules[{i}]: invalid severity")
        known = PARAMETERS.get(rule, [])
        out += [f"rules[{i}]: unknown parameter {k!r}" for k in given if k not in known]
        if r.get("enabled") and rule in ("CORE.SENTENCE_LENGTH", "CORE.DENSE_PARAGRAPH"):
            out += [f"rules[{i}]: missing parameter {k!r}" for k in known if k not in given]
        out += [f"rules[{i}]: parameter {k!r} must be a positive integer" for k, v in given.items() if rule != "CORE.CORPUS_NOVELTY" and (not isinstance(v, int) or isinstance(v, bool) or v <= 0)]
    if dictionary.get("format_version") not in (1, 2):
        out.append("dictionary: unsupported format_version")
    for name, words in dictionary.get("word_classes", {}).items():
        if not name or not all(words):
            out.append(f"dictionary: word class {name!r} has an empty name or word")
    index: dict[str, dict] = {}
    for e in dictionary.get("entries", []):
        term, status = e.get("term", ""), e.get("status")
        if not term:
            out.append("dictionary: empty term")
            continue
        if status not in STATUSES:
            out.append(f"dictionary: {term!r}: invalid status")
        if any(not p.strip() for p in e.get("parts_of_speech", [])) or (status in STATUSES - {"observed"} and not e.get("parts_of_speech")):
            out.append(f"dictionary: {term!r}: parts of speech")
        if status == "discouraged" and not e.get("reason", "").strip():
            out.append(f"dictionary: {term!r}: a discouraged term needs a reason")
        if fold(term) in index:
            out.append(f"dictionary: duplicate term {term!r}")
        index[fold(term)] = e
    for e in index.values():
        for alternative in e.get("alternatives", []) if e.get("status") == "discouraged" else []:
            if index.get(fold(alternative), {}).get("status") not in ("preferred", "allowed"):
                out.append(f"dictionary: {e['term']!r}: alternative {alternative!r} is no preferred or allowed term")
    return out


def load(folder: str | Path) -> Profile:
    """The bundle in a folder; raises with every fault at once."""
    folder = Path(folder)
    raw = {n: (folder / f"{n}.json").read_bytes() for n in ("manifest", "rules", "dictionary")}
    parsed = {n: json.loads(b) for n, b in raw.items()}
    wrong = faults(**parsed)
    payloads = parsed["manifest"].get("payloads") or {}
    wrong += [f"{n}.json: its hash isn't the manifest's" for n in ("dictionary", "rules") if payloads.get(f"{n}.json") != hashlib.sha256(raw[n]).hexdigest()]
    if wrong:
        raise ProfileError("; ".join(wrong))
    return Profile(**parsed, sha256=hashlib.sha256(raw["manifest"] + raw["rules"] + raw["dictionary"]).hexdigest(), source=str(folder))


def resolve(spec: str = "docs-en@1.0.0", installed: str | Path | None = None) -> Profile:
    """A profile by id@x.y.z, from a folder of installed ones or those of the package; one that is in both must be the same."""
    if not (m := re.fullmatch(r"([a-z0-9-]+)@(\d+\.\d+\.\d+)", spec)):
        raise ProfileError(f"{spec!r} isn't id@x.y.z")
    found = [load(d) for root in (installed, BUNDLED) if root and (d := Path(root) / m[1] / m[2]).is_dir()]
    if not found:
        raise ProfileError(f"no profile {spec}")
    if len({p.sha256 for p in found}) > 1:
        raise ProfileError(f"the installed {spec} differs from the package's")
    return found[0]


def profiles(installed: str | Path | None = None) -> list[tuple[str, str, str]]:
    """(id, version, sha256) of all profiles, by name."""
    found = {(p.manifest["id"], p.manifest["version"]): p.sha256 for root in (BUNDLED, installed) if root for f in Path(root).glob("*/*/manifest.json") for p in [load(f.parent)]}
    return [(*k, v) for k, v in sorted(found.items())]


def install(folder: str | Path, installed: str | Path) -> Profile:
    """Copies a sound bundle among the installed ones; whole or not at all."""
    p = load(folder)
    to = Path(installed) / p.manifest["id"] / p.manifest["version"]
    if to.exists():
        if load(to).sha256 != p.sha256:
            raise ProfileError(f"another {p.manifest['id']}@{p.manifest['version']} is installed")
        return p
    part = to.with_name(to.name + ".part")
    shutil.rmtree(part, ignore_errors=True)
    part.mkdir(parents=True)
    for n in ("manifest", "rules", "dictionary"):
        shutil.copyfile(Path(folder) / f"{n}.json", part / f"{n}.json")
    part.rename(to)
    return p


# --- configuration -------------------------------------------------------------------------------------------------

CONFIG = ".prosemill.toml"


def discover(start: str | Path) -> Path | None:
    """The nearest configuration file in a folder or above it."""
    start = Path(start).resolve()
    return next((d / CONFIG for d in (start, *start.parents) if (d / CONFIG).is_file()), None)


def configured(path: str | Path) -> dict:
    """profile, kind, fail_on and terms of a configuration file; other keys are passed over."""
    raw = tomllib.loads(Path(path).read_text())
    terms = raw.get("terms", [])
    wrong = [f"terms[{i}]: term and parts_of_speech are required" for i, t in enumerate(terms) if not t.get("term", "").strip() or not t.get("parts_of_speech")]
    folded = [fold(t.get("term", "")) for t in terms]
    wrong += [f"terms: duplicate {t!r}" for t in sorted({t for t in folded if folded.count(t) > 1})]
    wrong += [f"terms[{i}]: an override needs a reason" for i, t in enumerate(terms) if t.get("override") and not t.get("reason")]
    if wrong:
        raise ProfileError("; ".join(wrong))
    return {"profile": raw.get("profile"), "kind": raw.get("kind"), "fail_on": raw.get("fail_on"), "terms": terms}


def with_terms(profile: Profile, terms: list[dict]) -> Profile:
    """The profile with a project's terms; one that meets a discouraged term without overriding it is a fault."""
    if wrong := [t["term"] for t in terms if not t.get("override") and (profile.entry(t["term"]) or {}).get("status") == "discouraged"]:
        raise ProfileError(f"discouraged by the profile and not overridden: {', '.join(wrong)}")
    return Profile(profile.manifest, profile.rules, profile.dictionary, profile.sha256, profile.source, terms)


# --- the user's configuration --------------------------------------------------------------------------------------

#: What a user's configuration holds: a profile, and how the model is reached.
USER_KEYS = {"profile": str, "base_url": str, "model": str, "code_model": str, "api_key": str, "api_key_env": str, "timeout": float, "response_mode": str, "max_requests": int, "context_tokens": int}


def user_config_path() -> Path:
    base = os.environ.get("XDG_CONFIG_HOME")
    return (Path(base) if base else Path.home() / ".config") / "prosemill" / "config.toml"


def user_config(path: str | Path | None = None) -> dict:
    """The user's configuration, empty without a file; other keys are passed over, wrong kinds of values are faults."""
    path = Path(path) if path else user_config_path()
    if not path.is_file():
        return {}
    raw = tomllib.loads(path.read_text())
    kinds = {float: (int, float), int: int, str: str}
    if wrong := [k for k, t in USER_KEYS.items() if k in raw and (not isinstance(raw[k], kinds[t]) or isinstance(raw[k], bool))]:
        raise ProfileError(f"{path}: {', '.join(wrong)}")
    if raw.get("api_key") and raw.get("api_key_env"):
        raise ProfileError(f"{path}: give api_key or api_key_env, not both")
    return {k: raw[k] for k in USER_KEYS if k in raw}


def write_user_config(values: dict, path: str | Path | None = None) -> Path:
    """Writes a user's configuration whole or not at all, readable by the user alone."""
    path = Path(path) if path else user_config_path()
    if unknown := sorted(set(values) - set(USER_KEYS)):
        raise ProfileError(f"unknown: {', '.join(unknown)}")
    path.parent.mkdir(parents=True, exist_ok=True, mode=0o700)
    part = path.with_name(f".{path.name}.{os.getpid()}")
    try:
        with open(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as f:
            f.write("".join(f"{k} = {json.dumps(v)}\n" for k, v in values.items()))
        user_config(part)  # what was written can be read
        part.replace(path)
    finally:
        part.unlink(missing_ok=True)
    return path
