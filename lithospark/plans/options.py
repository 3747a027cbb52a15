"""Arguments of the composed commands."""

from __future__ import annotations


def entry_argument(text: str) -> tuple[str, str | None]:
    """package[:entry]; a colon among the first two characters belongs to a drive."""
    at = text.find(":", 2)
    return (text, None) if at < 0 else (text[:at], text[at + 1 :])


def assignments(texts: list[str]) -> list[tuple[str, str]]:
    """KEY=VALUE pairs; a value may hold further signs of equality."""
    pairs = [t.partition("=") for t in texts]
    if bad := [t for t, (k, sign, _) in zip(texts, pairs, strict=True) if not sign or not k]:
        raise ValueError(f"not KEY=VALUE: {', '.join(bad)}")
    return [(k, v) for k, _, v in pairs]
