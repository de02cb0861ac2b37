"""The bundled ruleset for journal manuscripts, and its prompts."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from galley.errors import RulesetError
from galley.plans.ruleset import Ruleset, load

#: Fixed values, in the order in which rules are declared: sections and the headings that name them, ids, attributes, values,
#: severities and priorities of rules. Messages and prompts are this library's own.
FOLDER = Path(__file__).parent
BUNDLED = ("journal_v1",)


@cache
def bundled(ruleset_id: str = "journal_v1") -> Ruleset:
    """A bundled ruleset by its id."""
    if ruleset_id not in BUNDLED:
        raise RulesetError(f"no bundled ruleset {ruleset_id!r}")
    return load(FOLDER / f"{ruleset_id}.json")


def journal() -> Ruleset:
    """The bundled ruleset for journals."""
    return bundled("journal_v1")
