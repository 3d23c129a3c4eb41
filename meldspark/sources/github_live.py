"""Profiles fetched from GitHub's public REST API, for ``readers.github_records``. Nothing else in
the library goes online; callers opt in by calling this."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

API = "https://api.github.com"


def get_json(url: str):
    asked = urllib.request.Request(url, headers={"User-Agent": "meldspark", "Accept": "application/vnd.github+json"})
    with urllib.request.urlopen(asked, timeout=15) as answer:
        return json.load(answer)


def fetch_github(spark: SparkSession, users: list[str], get: Callable[[str], object] = get_json) -> DataFrame:
    """``(source_id, v)`` for a short list of user names, asked for one after the other by the driver;
    an answer that is no object gives null."""
    rows = []
    for user in users:
        profile, repos = get(f"{API}/users/{user}"), get(f"{API}/users/{user}/repos?per_page=100&sort=updated")
        if isinstance(profile, dict):
            profile = {**profile, "languages": [], "repositories": repos if isinstance(repos, list) else []}
        rows.append((f"{API}/users/{user}", json.dumps(profile) if isinstance(profile, dict) else None))
    return spark.createDataFrame(rows, "source_id string, t string").select("source_id", F.try_parse_json("t").alias("v"))
