"""Features of one session by plain loops, as an independent check."""

import math
from collections import Counter

import numpy as np

BOT_WORDS = ("python", "scrapy", "curl", "wget", "java", "go-http", "okhttp")


def std(values):
    return float(np.std(values, ddof=1)) if len(values) > 1 else 0.0


def entropy(values):
    p = np.array(list(Counter(values).values())) / len(values)
    return float(-(p * np.log2(p + 1e-12)).sum())


def section(url, default):
    return url.split("/")[1] if "/" in url else default


def features(rows):
    """rows: dicts of one session in order."""
    n = len(rows)
    t = np.array([r["timestamp_ms"] for r in rows])
    urls = [r["url"] for r in rows]
    status = np.array([r["status_code"] for r in rows])
    gap = np.diff(t)
    iat = gap if n > 1 else np.zeros(1)
    distinct = len(set(urls))
    heads = [len(r["headers"]) for r in rows]
    sizes = np.array([float(r["response_size_bytes"]) for r in rows])
    seconds = max((t[-1] - t[0]) / 1000, 0.001)
    depth = [u.rstrip("/").count("/") for u in urls]
    linked = np.mean([bool(r["referrer"]) for r in rows])
    errors = np.flatnonzero(status >= 400)
    out = {
        "http_iat_mean_ms": iat.mean(), "http_iat_std_ms": std(iat), "http_iat_cv": std(iat) / max(iat.mean(), 1e-6),
        "http_iat_min_ms": iat.min(), "http_iat_max_ms": iat.max(), "http_rpm_mean": 60 * n / seconds,
        "http_burst_ratio": (iat < 100).mean(), "http_session_depth": n, "http_session_duration_s": seconds,
        "http_error_rate": (status >= 400).mean(), "http_rate_4xx": ((status >= 400) & (status < 500)).mean(),
        "http_rate_404": (status == 404).mean(), "http_rate_5xx": (status >= 500).mean(),
        "http_unique_url_ratio": distinct / n, "http_url_entropy": entropy(urls),
        "http_api_ratio": np.mean([r["is_api"] for r in rows]), "http_depth_max": max(depth),
        "http_depth_mean": np.mean(depth), "http_header_completeness": min(np.mean(heads) / 10, 1),
        "http_header_mean_count": np.mean(heads),
        "http_post_ratio": np.mean([r["method"] == "POST" for r in rows]),
        "http_get_ratio": np.mean([r["method"] == "GET" for r in rows]),
        "http_req_size_mean": np.mean([r["request_size_bytes"] for r in rows]),
        "http_resp_size_mean": sizes.mean(), "http_resp_size_cv": std(sizes) / max(sizes.mean(), 1),
        "http_referrer_ratio": linked,
    }
    for key, name in (("sec_fetch", "sec-fetch-dest"), ("sec_ch_ua", "sec-ch-ua"), ("accept_language", "accept-language")):
        out[f"http_has_{key}"] = float(any(name in r["headers"] for r in rows))

    api = [u for u in urls if "/api/" in u]
    half = n // 2
    early, late = gap[:half], gap[half:]
    kinds = [sum("product" in u for u in urls), sum("products" in u or "category" in u for u in urls), len(api),
             sum("account" in u or "login" in u for u in urls), sum("static" in u or ".js" in u or ".css" in u for u in urls)]
    kinds.append(n - sum(kinds))
    momentum = 0.0
    if half > 1:
        first = early.sum() / half
        momentum = (late.sum() / max(len(late), 1) - first) / max(first, 1.0)
    behaviour = {
        "beh_revisit_ratio": 1 - distinct / n,
        "beh_backtrack_rate": sum(urls[i] in (urls[i - 2], urls[i - 3]) for i in range(3, n)) / max(n - 3, 1),
        "beh_n_unique_pages": distinct, "beh_path_entropy": entropy([section(u, u) for u in urls]),
        "beh_dwell_mean_ms": iat.mean(), "beh_dwell_std_ms": std(iat), "beh_dwell_cv": std(iat) / max(iat.mean(), 1),
        "beh_short_dwell_ratio": (iat < 500).mean(), "beh_momentum": momentum,
        "beh_content_diversity": sum(k > 0 for k in kinds) / 6, "beh_referrer_chain_rate": linked,
        "beh_api_rate": len(api) / n, "beh_api_variety": len(set(api)) / max(len(api), 1),
        "beh_continued_after_error": (n - 1 - errors[-1]) / n if len(errors) else 0.0,
    }
    out |= {k: v if n > 1 else 0.0 for k, v in behaviour.items()}

    cv = std(iat) / max(iat.mean(), 1)
    peak = 0.3 if cv < 0.05 else max(0, 1 - abs(cv - 0.15) / 0.35) if cv < 0.35 else max(0, 1 - (cv - 0.35) / 2)
    breadth = len({section(u, "") for u in urls}) / distinct
    head = heads[0]
    agents = [r["user_agent"] for r in rows]
    bot = 0.95 if any(w in agents[0].lower() for w in BOT_WORDS) else 0.0
    probes = [r["url"].split("?")[0] for r in rows if r["is_api"] or "/api/" in r["url"]]
    probing = min(1, 3 * len(probes) / n * (0.5 + 0.5 * len(set(probes)) / len(probes))) if probes and n > 2 else 0.0
    forward = sum(urls[i] not in urls[max(0, i - 5):i] for i in range(1, n))
    signals = {
        "timing_regularity": peak if n > 4 else 0.0,
        "systematic_coverage": min(1, distinct / n * (0.7 + 0.3 * breadth)) if n > 4 else 0.0,
        "header_anomaly": 0.9 if head < 4 else 0.7 if head < 7 else 0.3 if head < 10 else 0.1,
        "ua_mismatch": 0.9 if len(set(agents)) > 1 else bot, "api_probing": probing, "form_naturalness": 0.0,
        "session_linearity": forward / (n - 1) if n > 4 else 0.0,
    }
    weight = dict(zip(signals, (0.2, 0.2, 0.15, 0.1, 0.15, 0.1, 0.1)))
    score = sum(weight[k] * v for k, v in signals.items()) + (min(0.15, (n - 20) / 300) if n > 20 else 0)
    out |= {f"llm_{k}": v for k, v in signals.items()} | {"llm_llm_score": min(1.0, score)}
    return {k: float(v) for k, v in out.items()}


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)


def auroc(labels, scores):
    """Share of positive and negative pairs in the right order, ties count half."""
    pos = [s for y, s in zip(labels, scores) if y]
    neg = [s for y, s in zip(labels, scores) if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def auprc(labels, scores):
    points = [(0.0, 1.0)]
    for cut in sorted(set(scores), reverse=True):
        hit = [y for y, s in zip(labels, scores) if s >= cut]
        points.append((sum(hit) / sum(labels), sum(hit) / len(hit)))
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
