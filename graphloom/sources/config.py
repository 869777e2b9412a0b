"""Configuration: TOML files, their validation, and resolution over project, global and default values."""

from __future__ import annotations

import tomllib
from pathlib import Path

from ..schema import CONTEXT_UNITS, IMPACT_DEPTH, REPORT_LIMIT

# Fixed values.
DEFAULTS = {"context_budget": CONTEXT_UNITS, "impact_depth": IMPACT_DEPTH, "report_limit": REPORT_LIMIT}
POLICIES = ("unrestricted", "allow", "deny", "prohibit")
RULE_KINDS = ("prohibited_dependency", "layer_boundary", "package_boundary", "prohibited_relationship", "isolated_component")
SEVERITIES = ("error", "warning", "info", "blocker")
#: Section names and the shorter ones that may stand for them.
ALIASES = {"package_policy": ("packages", "boundaries"), "rules": ("structural_rules",)}


class ConfigurationError(ValueError):
    """What is wrong, one message a line."""


def load(path: str) -> dict:
    """A TOML file; a missing one is empty."""
    file = Path(path)
    if not file.exists():
        return {}
    try:
        return tomllib.loads(file.read_text(encoding="utf-8"))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as error:
        raise ConfigurationError(f"{path}: {error}") from error


def validate(raw: dict) -> dict:
    """Settings, package policy and rules in one shape."""
    wrong, out = [], {k: v for k, v in raw.items() if not isinstance(v, (dict, list))}
    for name, value in out.items():
        if name in DEFAULTS and (isinstance(value, bool) or not isinstance(value, int) or value < 1):
            wrong.append(f"{name} must be a whole number above 0")
    sections = {}
    for name, aliases in ALIASES.items():
        given = [n for n in (name, *aliases) if n in raw]
        if len(given) > 1:
            wrong.append(f"{' and '.join(given)} say the same; give one")
        sections[name] = raw.get(given[0]) if given else None
    policy = sections["package_policy"] or {}
    rules = []
    if not isinstance(policy, dict):
        wrong.append("package_policy must be a table")
        policy = {}
    if policy.get("default_policy", "unrestricted") not in POLICIES:
        wrong.append(f"default_policy must be one of {', '.join(POLICIES)}")
    for k, rule in enumerate(policy.get("deny", [])):
        if isinstance(rule, str):
            source, arrow, target = (x.strip() for x in rule.partition("->"))
            rule = {"source": source, "target": target} if arrow else {}
        rules.append({"policy": "deny", **rule} if isinstance(rule, dict) else {})
    rules += [r if isinstance(r, dict) else {} for r in policy.get("rules", [])]
    for k, rule in enumerate(rules):
        if not rule.get("source") or not rule.get("target"):
            wrong.append(f"package rule {k + 1} needs source and target")
        elif rule.setdefault("policy", "deny") not in POLICIES[1:]:
            wrong.append(f"package rule {k + 1} has an unknown policy")
        else:
            rule.setdefault("rule_id", f"{rule['source']}->{rule['target']}")
    structural = sections["rules"] or []
    if not isinstance(structural, list):
        wrong.append("rules must be a list of tables")
        structural = []
    for k, rule in enumerate(structural):
        if not isinstance(rule, dict) or rule.get("kind") not in RULE_KINDS:
            wrong.append(f"rule {k + 1} has an unknown kind")
        elif not rule.get("source"):
            wrong.append(f"rule {k + 1} needs a source")
        elif rule["kind"] != "isolated_component" and not rule.get("target"):
            wrong.append(f"rule {k + 1} needs a target")
        elif rule.setdefault("severity", "error") not in SEVERITIES:
            wrong.append(f"rule {k + 1} has an unknown severity")
    if wrong:
        raise ConfigurationError("\n".join(wrong))
    return out | {"package_policy": {"default_policy": policy.get("default_policy", "unrestricted"), "rules": rules}, "rules": structural}


def resolve(project: dict | None = None, everywhere: dict | None = None) -> dict[str, tuple]:
    """key -> (value, provenance) by project, then global, then default."""
    layers = (("project", project or {}), ("global", everywhere or {}), ("default", DEFAULTS))
    keys = dict.fromkeys(k for _, layer in layers for k in layer)
    return {k: next((layer[k], name) for name, layer in layers if layer.get(k) is not None) for k in keys if any(layer.get(k) is not None for _, layer in layers)}


def audit(project_path: str | None = None, global_path: str | None = None, known: tuple[str, ...] = tuple(DEFAULTS)) -> dict:
    """What the two files give together: status (default, valid, invalid), values, precedence, presence and diagnostics.

    Every file is looked at whatever is wrong with the other; a blocker of either leaves no values. ``precedence``
    says of each key in ``known`` which layer its value is from.
    """
    found: dict[str, dict] = {}
    present, diagnostics = {}, []
    for layer, path in (("project", project_path), ("global", global_path)):
        file = Path(path) if path else None
        present[layer] = file is not None and file.exists()
        found[layer] = {}
        if not present[layer]:
            continue
        try:
            if not file.is_file():
                diagnostics.append(("CONFIG_NOT_A_FILE", path, "it is no file"))
                continue
            raw = load(path)
        except ConfigurationError as error:
            diagnostics.append(("CONFIG_LOAD_ERROR", path, str(error)))
            continue
        except OSError as error:
            diagnostics.append(("CONFIG_IO_ERROR", path, str(error)))
            continue
        try:
            found[layer] = validate(raw)
        except ConfigurationError as error:
            diagnostics += [("CONFIG_VALIDATION_ERROR", path, line) for line in str(error).split("\n")]
    out = {"present": present, "diagnostics": [{"severity": "blocker", "code": c, "path": p, "message": m, "source": "config"} for c, p, m in diagnostics]}
    if diagnostics:
        return out | {"status": "invalid", "values": None, "precedence": {}}
    values = resolve(found["project"], found["global"])
    return out | {"status": "valid" if any(present.values()) else "default", "values": {k: v for k, (v, _) in values.items()}, "precedence": {k: values[k][1] for k in known}}
