"""Recordings of code-hosting users: what the live service says, kept as a file that the engine reads like any other."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable
from pathlib import Path

# Addresses of the public interface, and how many repositories a page holds.
USER, REPOS, PAGE = "https://api.github.com/users/{login}", "https://api.github.com/users/{login}/repos?per_page={size}&page={page}", 100

USER_FIELDS = ("login", "name", "company", "blog", "location", "bio", "email", "html_url", "public_repos")
REPO_FIELDS = ("name", "language", "fork", "stargazers_count")


def record(login: str, get: Callable[[str], object], folder: str) -> Path:
    """Ask ``get`` (address -> parsed JSON) for a user and all repositories and write ``<login>.json`` to ``folder``.

    The engine itself never calls a network; ``get`` brings the client, its token and its limits.
    """
    user = get(USER.format(login=login))
    repos: list[dict] = []
    while len(page := get(REPOS.format(login=login, size=PAGE, page=len(repos) // PAGE + 1))) == PAGE:
        repos += page
    repos += page
    kept = {
        "user": {k: user.get(k) for k in USER_FIELDS},
        "repos": [{k: r.get(k) for k in REPO_FIELDS} for r in repos],
        "languages": dict(sorted(Counter(r["language"] for r in repos if r.get("language")).items())),
    }
    path = Path(folder) / f"{login}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(kept, indent=2, ensure_ascii=False), encoding="utf-8")
    return path
