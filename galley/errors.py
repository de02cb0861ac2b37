"""What this library refuses, by kind. What fails for one document or one fix is a row with its reason, not an error."""


class GalleyError(Exception):
    """Anything this library refuses."""


class DocumentError(GalleyError):
    """A file that can't be opened, read or written."""


class UnsupportedDocumentError(DocumentError):
    """A file that is no readable Word document."""


class RulesetError(GalleyError):
    """A ruleset that can't be used; names the rule and the field."""


class SettingsError(GalleyError):
    """Settings that can't be read or written."""
