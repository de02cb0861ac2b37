"""Rulesets: strict schema, loading with errors that name rule and field."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Annotated, Any, Literal, Union

from pydantic import BaseModel, ConfigDict, Field, ValidationError, model_validator

from galley.errors import RulesetError
from galley.operators.predicates import OPERATORS, UNARY

#: Sections, and those that belong to the front matter.
SECTIONS = (
    "title", "author", "abstract", "affiliation", "introduction", "methods_and_materials", "result", "discussion", "conclusion",
    "conflict_of_interest", "funding", "acknowledgement", "references", "corresponding_author_address", "unknown",
)
FRONT_MATTER = ("title", "author", "abstract", "affiliation")
BODY = tuple(s for s in SECTIONS if s not in {*FRONT_MATTER, "unknown"})
#: Fix actions and the attribute that each writes, by which they can conflict.
ACTIONS = {
    "set_font": "font_name", "set_font_size": "font_size_pt", "set_bold": "bold", "set_italic": "italic", "set_superscript": "superscript",
    "set_uppercase_literal": "text", "set_citation_brackets": "text", "strip_trailing_colon": "text", "insert_line_break": "line_break_after",
    "set_numbering_style": "numbering_style", "set_caption_position": "caption_position", "set_title_case": "text", "suggest_only": "none",
}
SEVERITIES = ("high", "medium", "low")

Section = Literal[SECTIONS]  # type: ignore[valid-type]
Severity = Literal[SEVERITIES]  # type: ignore[valid-type]


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid", frozen=True)


class Condition(_Strict):
    attribute: str
    operator: Literal[tuple(OPERATORS)]  # type: ignore[valid-type]
    value: Any = None

    @model_validator(mode="after")
    def _needs_value(self):
        if self.value is None and self.operator not in UNARY:
            raise ValueError(f"operator {self.operator} needs a value")
        return self


class Selector(_Strict):
    node_type: Literal["run", "paragraph", "table", "figure", "document", "section_text"] = "run"
    scope: Literal["every", "any", "first"] = "every"
    paragraph_filter: Condition | None = None
    filter: Condition | None = None


class _Rule(_Strict):
    rule_id: str = Field(min_length=1)
    category: str = ""
    applies_to_section: tuple[Section, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    selector: Selector = Selector()
    severity: Severity = "medium"
    priority: int = 100
    on_missing_section: Literal["skip", "violation", "check_failed"] = "skip"
    auto_fixable: bool = False
    message: str = ""


class DeterministicRule(_Rule):
    check_type: Literal["deterministic"]
    condition: Condition
    fix_action: Literal[tuple(ACTIONS)] | None = None  # type: ignore[valid-type]
    fix_params: dict[str, Any] = {}
    expected_repr: str = ""

    @model_validator(mode="after")
    def _fixable_with_action(self):
        if self.auto_fixable != (self.fix_action is not None):
            raise ValueError("auto_fixable needs a fix_action, and a fix_action needs auto_fixable")
        return self

    @property
    def expected(self) -> str:
        c = self.condition
        return self.expected_repr or f"{c.attribute} {c.operator} {c.value}"


class SemanticRule(_Rule):
    check_type: Literal["semantic"]
    prompt_template: str | None = None
    prompt_file: str | None = None
    prompt_vars: tuple[str, ...] = ()

    @model_validator(mode="after")
    def _one_prompt(self):
        if (self.prompt_template is None) == (self.prompt_file is None):
            raise ValueError("exactly one of prompt_template and prompt_file is needed")
        if self.auto_fixable:
            raise ValueError("a semantic rule can't be auto_fixable")
        return self


Rule = Annotated[Union[DeterministicRule, SemanticRule], Field(discriminator="check_type")]


class Ruleset(_Strict):
    ruleset_id: str
    ruleset_version: str
    journal_name: str = ""
    section_order: tuple[Section, ...] = ()
    required_sections: tuple[Section, ...] = ()
    optional_sections: tuple[Section, ...] = ()
    section_synonyms: dict[Section, tuple[str, ...]] = {}
    defaults: dict[str, Any] = {}
    rules: tuple[Rule, ...] = ()

    @model_validator(mode="after")
    def _unique(self):
        ids = [r.rule_id for r in self.rules]
        twice = sorted({i for i in ids if ids.count(i) > 1})
        if twice:
            raise ValueError(f"rule_id used twice: {', '.join(twice)}")
        return self

    def by_id(self, rule_id: str):
        return next((r for r in self.rules if r.rule_id == rule_id), None)

    def with_presence_rules(self) -> Ruleset:
        """This ruleset with a rule for the presence of each required section."""
        more = [
            DeterministicRule(rule_id=f"section-present-{s}", category="structure", check_type="deterministic", selector=Selector(node_type="document"),
                              condition=Condition(attribute=f"section:{s}", operator="is_non_empty"), severity="high", expected_repr=f"section '{s}' present",
                              message=f"The section '{s}' is required.")
            for s in self.required_sections
        ]
        return self.model_copy(update={"rules": (*self.rules, *(r for r in more if self.by_id(r.rule_id) is None))})

    def ordered(self) -> list:
        """Deterministic rules by priority and place, then semantic ones by place."""
        rules = sorted(enumerate(self.rules), key=lambda x: (x[1].check_type != "deterministic", x[1].priority if x[1].check_type == "deterministic" else 0, x[0]))
        return [r for _, r in rules]


def parse(text: str, source: str = "ruleset") -> Ruleset:
    """A ruleset from JSON; errors name the rule and the field."""
    try:
        data = json.loads(text)
    except ValueError as e:
        raise RulesetError(f"{source}: not JSON: {e}") from e
    try:
        return Ruleset.model_validate(data)
    except ValidationError as e:
        raise RulesetError(f"{source}: " + "; ".join(_where(data, x) for x in e.errors())) from e


def _where(data: Any, error: Any) -> str:
    at = [x for x in error["loc"] if x not in {"deterministic", "semantic"}]
    if at[:1] == ["rules"] and len(at) > 1:
        rules = data.get("rules") if isinstance(data, dict) else None
        own = rules[at[1]] if isinstance(rules, list) else None
        name = own.get("rule_id", f"#{at[1]}") if isinstance(own, dict) else f"#{at[1]}"
        return f"rule {name}, {'.'.join(map(str, at[2:])) or 'rule'}: {error['msg']}"
    return f"{'.'.join(map(str, at)) or 'ruleset'}: {error['msg']}"


def load(path: str | Path) -> Ruleset:
    """A ruleset from a file."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise RulesetError(f"{path}: {e.strerror}") from e
    return _with_prompts(parse(text, str(path)), Path(path).parent)


def _with_prompts(ruleset: Ruleset, folder: Path) -> Ruleset:
    """Prompt files, which lie beside the ruleset, read into their rules."""
    rules = []
    for rule in ruleset.rules:
        if isinstance(rule, SemanticRule) and rule.prompt_file is not None:
            try:
                text = (folder / rule.prompt_file).read_text(encoding="utf-8")
            except OSError as e:
                raise RulesetError(f"rule {rule.rule_id}, prompt_file: {folder / rule.prompt_file}: {e.strerror}") from e
            rule = rule.model_copy(update={"prompt_template": text, "prompt_file": None})
        rules.append(rule)
    return ruleset.model_copy(update={"rules": tuple(rules)})
