"""Interest tags of user profiles and groups of tags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedloom import vocab


def expand_profile(profile: dict | None) -> list[str]:
    """One profile, driver side: tech stack as it is, the rest through the expansion tables."""
    if not profile:
        return []
    out = list(profile.get("tech_stack") or [])
    for part, table in (("skills", vocab.SKILL_TAGS), ("tools", vocab.TOOL_TAGS), ("providers", vocab.PROVIDER_TAGS)):
        for name in profile.get(part) or []:
            out += table.get(name, [name])
    return sorted(set(out))


def _expand(names: Column, table: dict) -> Column:
    lookup = F.create_map(
        *[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    )
    return F.flatten(F.transform(names, lambda n: F.coalesce(lookup[n], F.array(n))))


def profile_tags(profile: Column) -> Column:
    """The same for a column of struct<tech_stack, skills, tools, providers>: all users at once."""
    none = F.array().cast("array<string>")

    def part(name):
        return F.coalesce(profile[name], none)

    return F.array_sort(
        F.array_distinct(
            F.concat(
                part("tech_stack"),
                _expand(part("skills"), vocab.SKILL_TAGS),
                _expand(part("tools"), vocab.TOOL_TAGS),
                _expand(part("providers"), vocab.PROVIDER_TAGS),
            )
        )
    )


def expand_group(topic: str) -> list[str] | None:
    return vocab.TAG_GROUPS.get(topic)


def group_tags(topic: Column) -> Column:
    """The tags of a group, or the topic alone when it names no group."""
    lookup = F.create_map(
        *[x for k, v in vocab.TAG_GROUPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    )
    return F.coalesce(lookup[topic], F.array(topic))


def resolve_persona(persona: str | None, *, days=7, sort=None, limit=20, types=None, significance=None, new=False):
    """Preset values fill in only what the caller left at its default."""
    preset = vocab.PERSONAS.get(persona or "", {})
    return {
        "days": preset.get("days", days) if days == 7 else days,
        "sort": sort if sort is not None else preset.get("sort"),
        "limit": preset.get("limit", limit) if limit == 20 else limit,
        "types": types if types else preset.get("types"),
        "significance": significance if significance else preset.get("significance"),
        "new": new or preset.get("new", False),
    }
