"""Thresholds: two built-in sets, and YAML files of the form section -> key -> value."""

from __future__ import annotations

import logging
from numbers import Number

logger = logging.getLogger(__name__)
SECTIONS = ("code_smells", "architectural_smells", "structural_smells")

# The shared part of both built-in sets.
_COMMON = {
    "code_smells": {
        "ALTERNATIVE_CLASSES_THRESHOLD": 3, "COMPLEX_CONDITIONAL": 3, "DATA_CLUMPS_THRESHOLD": 6, "DEAD_CODE_THRESHOLD": 3, "DIVERGENT_CHANGE_METHODS": 5, "DIVERGENT_CHANGE_PREFIXES": 4, "DUPLICATE_CODE_MIN_LINES": 5, "DUPLICATE_CODE_THRESHOLD": 15,
        "EXCESSIVE_COMMENTS_RATIO": 0.3, "FEATURE_ENVY_CALLS": 3, "INAPPROPRIATE_INTIMACY_SHARED": 3, "LARGE_CLASS_METHODS": 15, "LARGE_COMMENT_BLOCKS": 5, "LAZY_CLASS_METHODS": 4, "LONG_METHOD_LINES": 45, "LONG_PARAMETER_LIST": 5, "MESSAGE_CHAIN_LENGTH": 3,
        "MIDDLE_MAN_RATIO": 0.5, "PRIMITIVE_OBSESSION_COUNT": 4, "SHOTGUN_SURGERY_CALLS": 5, "SHOTGUN_SURGERY_CONTEXTS": 3, "SPECULATIVE_GENERALITY_THRESHOLD": 4, "TEMPORARY_FIELD_THRESHOLD": 3, "UNUSED_PARAMETERS_THRESHOLD": 6,
    },
    "architectural_smells": {"GOD_OBJECT_FUNCTIONS": 20, "UNSTABLE_DEPENDENCY_THRESHOLD": 0.8},
    "structural_smells": {
        "CBO_THRESHOLD": 5, "CYCLOMATIC_COMPLEXITY_THRESHOLD": 10, "DIT_THRESHOLD": 3, "LCOM_THRESHOLD": 10, "LOC_THRESHOLD": 150, "MAX_BRANCHES": 10, "MAX_FANIN": 15, "MAX_FANOUT": 15, "MAX_FILE_LENGTH": 250, "MAX_NESTING_DEPTH": 4, "MPC_THRESHOLD": 25,
        "NOCC_THRESHOLD": 10, "NOC_THRESHOLD": 7, "NOM_THRESHOLD": 10, "RFC_THRESHOLD": 20, "SIZE2_THRESHOLD": 15, "WAC_THRESHOLD": 10, "WMPC1_THRESHOLD": 20, "WMPC2_THRESHOLD": 20,
    },
}
# What only the smaller set has.
_PACKAGED_ONLY = {"architectural_smells": {"CYCLIC_DEPENDENCY_MAX_LENGTH": 3, "HUB_LIKE_DEPENDENCY_RATIO": 0.3, "IMPROPER_API_USAGE_RATIO": 0.7, "REDUNDANT_ABSTRACTION_SIMILARITY": 0.7}}
# Defaults of the optional keys, which the larger set states.
DEFAULTS = {
    "code_smells": {
        "DATA_CLUMP_MIN_COMBO_SIZE": 3, "FEATURE_ENVY_LOCAL_RATIO": 2.0, "INAPPROPRIATE_INTIMACY_METHOD_RATIO": 0.3, "MIDDLE_MAN_MAX_DELEGATE_TARGETS": 2, "PARALLEL_INHERITANCE_SIMILARITY_THRESHOLD": 0.3, "PRIMITIVE_MIN_ARGS": 3, "PRIMITIVE_RATIO_THRESHOLD": 0.7,
        "SHOTGUN_SURGERY_EXCLUDE_NAMES": ["log", "print", "str", "len", "isinstance", "super"],
    },
    "architectural_smells": {
        "API_REPETITION_MIN_COUNT": 3, "API_REPETITION_THRESHOLD": 0.4, "CYCLE_EXCLUDED_MODULES": ["__init__", "utils", "common", "base", "core"], "CYCLE_HIGH_MIN_SIZE": 3, "CYCLE_HIGH_MIN_STRENGTH": 3, "HUB_BALANCE_RATIO_MAX": 5, "HUB_BALANCE_RATIO_MIN": 0.2,
        "HUB_LIKE_DEPENDENCY_THRESHOLD": 0.5, "HUB_MIN_PROJECT_MODULES": 3, "MAX_CYCLE_SIZE": 5, "MIN_API_CALLS": 10, "MIN_CYCLE_SIZE": 2, "MIN_DEPENDENCIES": 5, "MIN_GOD_OBJECT_FUNCTIONS": 5, "MIN_HUB_CONNECTIONS": 5, "MIN_PROJECT_SIZE": 3, "MIN_SCATTERED_OCCURRENCES": 3,
        "ORPHAN_EXCLUDED_MODULES": ["__init__", "setup", "tests", "utils"], "REDUNDANT_MIN_FUNCTIONS": 3, "REDUNDANT_SIMILARITY_THRESHOLD": 0.8, "SCATTERED_EXCLUDED_NAMES": ["main", "init", "setup", "test"], "SCATTERED_MIN_FUNCTION_NAME_LENGTH": 3,
    },
    "structural_smells": {
        "BRANCH_EXCLUDE_DECORATORS": ["property"], "BRANCH_EXCLUDE_METHOD_PREFIXES": ["get_", "set_", "is_"], "CBO_DIRECT_WEIGHT": 1.5, "CBO_INDIRECT_WEIGHT": 0.5, "CYCLOMATIC_COMPLEXITY_THRESHOLD": 10,
        "FRAMEWORK_BASES": ["object", "Exception", "dict", "list", "set", "tuple", "str", "int", "float"], "LOC_DOC_COMPLEXITY_MULTIPLIER": 1.3, "LOC_DOC_COMPLEXITY_RATIO_BREAKPOINT": 0.5, "LOC_TEST_FILE_MULTIPLIER": 1.5, "MAX_BRANCHES": 10, "MAX_FANIN": 15, "MAX_FANOUT": 15, "MAX_FILE_LENGTH": 250,
        "MAX_NESTING_DEPTH": 3, "MPC_EXTERNAL_WEIGHT": 1.5, "NOCC_AVG_WEIGHT_BOUND_HIGH": 15, "NOCC_AVG_WEIGHT_BOUND_LOW": 5, "NOCC_MULTIPLIER_HIGH": 0.7, "NOCC_MULTIPLIER_LOW": 1.5, "NOC_LOC_BREAKPOINT_HIGH": 10000, "NOC_LOC_BREAKPOINT_MEDIUM": 5000, "NOC_LOC_MULTIPLIER_HIGH": 1.5,
        "NOC_LOC_MULTIPLIER_MEDIUM": 1.2, "NOM_THRESHOLD": 10,
    },
}
# Keys without a default that only the larger set has.
_EXTENDED_ONLY = {"code_smells": {"DATA_CLASS_METHODS": 4, "LAZY_CLASS_LINES": 50}}

PACKAGED = {s: _COMMON[s] | _PACKAGED_ONLY.get(s, {}) for s in SECTIONS}
EXTENDED = {s: DEFAULTS[s] | _COMMON[s] | _EXTENDED_ONLY.get(s, {}) for s in SECTIONS}
#: Structural keys that a configuration should have.
REQUIRED = ("NOM_THRESHOLD", "WMPC1_THRESHOLD", "WMPC2_THRESHOLD", "SIZE2_THRESHOLD", "WAC_THRESHOLD", "LCOM_THRESHOLD", "RFC_THRESHOLD", "NOCC_THRESHOLD", "DIT_THRESHOLD", "LOC_THRESHOLD", "MPC_THRESHOLD")


class Thresholds:
    """The values of one section. t[key] is required (KeyError), t.get(key) falls back to the optional key's default."""

    def __init__(self, section: str, values: dict):
        self.section, self.values = section, values

    def __getitem__(self, key: str):
        return self.values[key]

    def __contains__(self, key: str) -> bool:
        return key in self.values

    def get(self, key: str):
        return self.values.get(key, DEFAULTS[self.section].get(key))


def load(source: str | dict | None = None) -> dict[str, Thresholds]:
    """Thresholds by section from a YAML file, a dict (of values or of {value: ...}), or the packaged set (None)."""
    if source is None:
        raw = PACKAGED
    elif isinstance(source, dict):
        raw = source
    elif isinstance(source, str):
        import yaml

        with open(source, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
    else:
        raise ValueError("a configuration is a path or a dict")
    out = {}
    for s in SECTIONS:
        values = {k: v["value"] if isinstance(v, dict) and "value" in v else v for k, v in (raw.get(s) or {}).items()}
        out[s] = Thresholds(s, values)
    return out


def check(config: dict[str, Thresholds]) -> list[str]:
    """Warnings about a configuration: missing structural keys, values that are no positive number or list."""
    found = [f"missing structural threshold {k}" for k in REQUIRED if k not in config["structural_smells"]]
    for s, t in config.items():
        found += [f"{s}.{k} should be a positive number or a list: {v!r}" for k, v in t.values.items() if not (isinstance(v, list) or isinstance(v, Number) and v > 0)]
    for x in found:
        logger.warning(x)
    return found
