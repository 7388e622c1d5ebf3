"""Settings. Frozen dataclasses on the driver; every value becomes a literal in a plan."""

from __future__ import annotations

from dataclasses import dataclass, field

# Traffic classes with their numeric label.
CLASS_LABELS = {
    "human": 0,
    "simple_bot": 1,
    "scraper": 2,
    "cred_stuffer": 3,
    "llm_agent": 4,
}

# User-agent fragments of scripted clients.
BOT_AGENT_WORDS = ("python", "scrapy", "curl", "wget", "java", "go-http", "okhttp")

# JA3 hashes of known automation stacks.
KNOWN_JA3 = (
    "e7d705a3286e19ea42f587b344ee6865",
    "5765db2da7f2bfc028a93aca42df2e45",
    "b32309a26951912be7dba376398abc3b",
    "3b5074b1b5d032e5620f69f9f700ff0e",
)

# Headers every browser sends.
BROWSER_HEADERS = (
    "accept",
    "accept-language",
    "accept-encoding",
    "sec-fetch-dest",
    "sec-ch-ua",
)

# Networks of good crawlers.
ALLOWED_ASNS = ("AS15169", "AS8075", "AS16509")


@dataclass(frozen=True)
class ScaleSettings:
    """When a key counts as hot, and how large the pieces of a hot key are."""

    hot_rows: int = 500_000
    chunk_rows: int = 250_000


# Fixed values from here on: windows, thresholds, weights, floors and shifts of the definitions.


@dataclass(frozen=True)
class FeatureSettings:
    session_gap_seconds: int = 300
    min_requests_to_score: int = 3
    iat_bins: int = 20
    url_entropy_window: int = 50
    regularity_run: int = 5
    browser_headers: tuple[str, ...] = BROWSER_HEADERS
    known_ja3: tuple[str, ...] = KNOWN_JA3


@dataclass(frozen=True)
class RuleSettings:
    rate_warn_rpm: float = 60.0
    rate_block_rpm: float = 300.0
    iat_cv_bot: float = 0.4
    zscore: float = 3.0
    max_consecutive_404s: int = 5
    max_human_depth: int = 50


@dataclass(frozen=True)
class AgentSettings:
    timing_std_ms: float = 150.0
    weights: dict[str, float] = field(default_factory=lambda: {
        "timing_regularity": 0.20,
        "systematic_coverage": 0.20,
        "header_anomaly": 0.15,
        "ua_mismatch": 0.10,
        "api_probing": 0.15,
        "form_naturalness": 0.10,
        "session_linearity": 0.10,
    })


@dataclass(frozen=True)
class ModelSettings:
    forest_trees: int = 100
    forest_sample: int = 256
    boost_trees: int = 200
    boost_depth: int = 5
    boost_rate: float = 0.05
    boost_subsample: float = 0.8
    seed: int = 42
    min_training_sessions: int = 0  # 500 is the recommended floor; 0 switches the check off
    top_features: int = 30


@dataclass(frozen=True)
class EnsembleSettings:
    statistical: float = 0.25
    isolation: float = 0.25
    boosting: float = 0.30
    agent: float = 0.20
    override_at: float = 0.95
    min_agreement: int = 2


@dataclass(frozen=True)
class MitigationSettings:
    # lower bound of risk per action, highest first
    floors: dict[str, float] = field(default_factory=lambda: {
        "block": 0.85,
        "challenge": 0.70,
        "throttle": 0.55,
        "monitor": 0.30,
    })
    context_shift: dict[str, float] = field(default_factory=lambda: {
        "checkout": -0.10,
        "login": -0.10,
        "search": 0.05,
        "general": 0.0,
    })
    stricter_context: bool = False  # True subtracts the shift, so sensitive pages get stricter
    delay_ms: int = 2000
    throttle_rpm: int = 10
    block_ttl_s: int = 3600
    challenge_type: str = "js_proof_of_work"
    allowed_asns: tuple[str, ...] = ALLOWED_ASNS


@dataclass(frozen=True)
class HttpTextSettings:
    normal_train_file: str = "normalTrafficTraining.txt"
    normal_test_file: str = "normalTrafficTest.txt"
    anomalous_file: str = "anomalousTrafficTest.txt"
    session_size: int = 20
    seed: int = 42
    attach_body: bool = False


@dataclass(frozen=True)
class Settings:
    scale: ScaleSettings = field(default_factory=ScaleSettings)
    features: FeatureSettings = field(default_factory=FeatureSettings)
    rules: RuleSettings = field(default_factory=RuleSettings)
    agent: AgentSettings = field(default_factory=AgentSettings)
    models: ModelSettings = field(default_factory=ModelSettings)
    ensemble: EnsembleSettings = field(default_factory=EnsembleSettings)
    mitigation: MitigationSettings = field(default_factory=MitigationSettings)
    http_text: HttpTextSettings = field(default_factory=HttpTextSettings)


DEFAULT = Settings()
