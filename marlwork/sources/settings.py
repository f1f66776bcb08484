"""Settings from files: lists of keywords, patterns and bounds that replace the library's own."""

from __future__ import annotations

import json
import os
import pathlib


def find_settings(explicit: str | None = None, variable: str = "MARLWORK_SETTINGS", names: tuple[str, ...] = ("guardrails.yaml", "guardrails.json"), project: str | None = None) -> str | None:
    """The settings file: the one named, else that of the environment, else one in the working folder, else in the project's config folder; null without any."""
    named = explicit or os.environ.get(variable)
    if named:
        return named
    folders = [pathlib.Path.cwd() / "config", *([pathlib.Path(project) / "config"] if project else [])]
    return next((str(f / n) for f in folders for n in names if (f / n).is_file()), None)


def read_settings(path: str) -> dict:
    """The content of a JSON file, or of a YAML file where PyYAML is installed."""
    text = pathlib.Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def policies_of(settings: dict) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Keywords, lower-case, and templates by policy, of the policies that are enabled."""
    own = settings.get("policy_classifier", {})
    some = {k: v for k, v in own.get("categories", {}).items() if v.get("enabled", True)} if own.get("enabled", True) else {}
    return {k: [w.lower() for w in v.get("keywords", [])] for k, v in some.items()}, {k: v["refusal_template"] for k, v in some.items() if "refusal_template" in v}


def pii_of(settings: dict) -> tuple[list[tuple[str, str, str]], str, str | None]:
    """Patterns of personal data with what replaces them, the mode, and the refusal (null: the library's own)."""
    own = settings.get("pii_scrubber", {})
    some = own.get("patterns", {}) if own.get("enabled", True) else {}
    return [(k, v.get("regex", ""), v.get("placeholder", "[REDACTED]")) for k, v in some.items()], own.get("mode", "mask"), own.get("refusal_message")


def bounds_of(settings: dict) -> list[tuple[str, float, float, str]]:
    """Bounds of numbers by category, with their unit in the singular."""
    own = settings.get("output_validation", {}).get("numeric_validation", {}).get("bounds", {})
    return [(k, v["min"], v["max"], v.get("unit", "").rstrip("s")) for k, v in own.items()]


def checks_of(settings: dict) -> dict:
    """What answers are checked for, as answers.Checks takes it; what is switched off checks nothing."""
    own = settings.get("output_validation", {})
    on = lambda name: own.get("enabled", True) and own.get(name, {}).get("enabled", True)
    patterns = lambda name: [p.lower() for p in own.get(name, {}).get("patterns", [])] if on(name) else []
    return {"citations": on("citation_validation"), "bounds": bounds_of(settings) if on("numeric_validation") else [], "hallucinations": patterns("hallucination_patterns"), "advice": patterns("inappropriate_advice")}


#: Sizes of a search, by the variable that sets them. Fixed values.
SIZES = {"BM25_TOPK": 30, "DENSE_TOPK": 20, "CE_MAX_PAIRS": 40, "FINAL_TOPK": 8, "MIN_CHUNKS": 6}
#: Sizes for which an argument goes before the environment; for the others it is the other way round.
ARGUMENT_FIRST = ("BM25_TOPK", "DENSE_TOPK", "CE_MAX_PAIRS")


def sizes_of(arguments: dict[str, int] | None = None, environment: dict[str, str] | None = None) -> dict[str, int]:
    """The sizes of a search from its arguments (0 or absent: none), the environment (this process', if none is given) and SIZES."""
    env, own = os.environ if environment is None else environment, arguments or {}
    first = lambda name: own.get(name) or int(env.get(name, SIZES[name]))
    return {name: first(name) if name in ARGUMENT_FIRST else int(env.get(name) or own.get(name) or SIZES[name]) for name in SIZES}


def rewrites_queries(argument: bool = True, environment: dict[str, str] | None = None) -> bool:
    """Whether queries are rewritten: what USE_ADVANCED_REWRITE says, where it is set, whatever the argument."""
    told = (os.environ if environment is None else environment).get("USE_ADVANCED_REWRITE")
    return argument if told is None else told.lower() in ("1", "true", "yes")


def rewrites_of(settings: dict) -> tuple[list[tuple[str, str]], list[str]]:
    """Substitutions of query terms in order, and patterns of queries that are out of scope."""
    terms = settings.get("statutory_terms", [])
    pairs = terms.items() if isinstance(terms, dict) else ((x["pattern"], x["replacement"]) for x in terms)
    return list(pairs), list(settings.get("out_of_scope", []))
