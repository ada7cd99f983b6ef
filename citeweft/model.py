"""The data model: schemas of works, edges, histories, and the settings of a run."""

from __future__ import annotations

from dataclasses import dataclass, field


AUTHOR = "struct<surname:string,given:string,orcid:string>"
PROVENANCE = "struct<provider:string,direction:string,parent_key:string,iteration:int,retrieved_at:string,response_hash:string>"

WORKS_DDL = (
    "key string, title string, title_norm string, doi string, abstract string, year int, "
    f"authors array<{AUTHOR}>, venue string, type string, language string, is_retracted boolean, unresolved boolean, "
    f"source_ids map<string,string>, reference_count int, cited_by_count int, provenance array<{PROVENANCE}>"
)

EDGES_DDL = "src string, dst string, direction string, provider string"
DECISIONS_DDL = "key string, decision string"
HISTORY_DDL = (
    "n int, n_expanded int, n_raw int, n_after_dedup int, n_eligible int, n_screened int, n_included int, n_excluded int, "
    "cumulative_screened long, cumulative_included long, frontier_size int"
)
CACHE_DDL = (
    "cache_key string, provider string, method string, params string, retrieved_at string, http_status int, "
    "response_hash string, provider_version string, body string"
)

DIRECTIONS = ("backward", "forward", "seed")
INCLUDE, EXCLUDE, UNSCREENED = "include", "exclude", "unscreened"


@dataclass(frozen=True)
class Eligibility:
    """What a record must meet; ``keep_unknown`` leaves missing metadata to the screener."""

    year_min: int | None = None
    year_max: int | None = None
    types: tuple[str, ...] | None = None
    languages: tuple[str, ...] | None = None
    exclude_retracted: bool = True
    require_title: bool = True
    require_abstract: bool = False
    keep_unknown: bool = True


@dataclass(frozen=True)
class Arm:
    """A capture arm: all filters that are given must hold."""

    name: str
    directions: tuple[str, ...] | None = None
    providers: tuple[str, ...] | None = None
    member_of: str | None = None
    equals: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class DedupSettings:
    jw_threshold: float = 0.95
    max_cluster_size: int = 8
    precedence: tuple[str, ...] = ()


@dataclass(frozen=True)
class RankWeights:
    """Weights of the network ranker's features."""

    parents: float = 0.40
    cocitation: float = 0.25
    coupling: float = 0.25
    direction: float = 0.10


@dataclass(frozen=True)
class RunSettings:
    max_iterations: int = 10
    directions: tuple[str, ...] = ("backward", "forward")
    eligibility: Eligibility = field(default_factory=Eligibility)
    dedup: DedupSettings = field(default_factory=DedupSettings)
    arms: tuple[Arm, ...] = ()
    ranker: str = "bm25"
    top_k: int | None = None
    rules: tuple[tuple[str, dict], ...] = (("exhaustion", {}),)
    combine: str = "any_of"
    stop_method: str = "chapman"
