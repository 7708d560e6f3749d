"""A modelling table in contract form with a known effect."""

from __future__ import annotations

import math
import random

from offertide.operators.contract import PROCESSED_SCHEMA


def planted(spark, n=900, seed=7, sure_things=False, dead_control=False):
    """Conversion log-odds: -1.5 + 0.02 spend + 1.2 treatment + 0.5 view rate."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        wave = i % 6
        kind = ("bogo", "discount", "informational")[(i // 6) % 3]
        spend, views = rng.uniform(0, 100), rng.random()
        treatment = int(rng.random() < 0.7)
        sure = sure_things and i % 2 == 0
        if sure_things:
            p = 0.95 if sure else (0.9 if treatment else 0.05)
            spend = 90.0 + rng.random() if sure else 10.0 + rng.random()
        else:
            p = 1 / (1 + math.exp(1.5 - 0.02 * spend - 1.2 * treatment - 0.5 * views))
        converted = int(rng.random() < p) if not (dead_control and treatment == 0) else 0
        value = rng.uniform(10, 40) if converted else 0.0
        missing = i % 9 == 0
        record = {f.name: 0 if f.dataType.typeName() == "integer" else 0.0 for f in PROCESSED_SCHEMA.fields}
        record.update(
            account_id=f"c{i:05d}", offer_id=f"o{i % 4}", offer_type=kind, received_time=7.0 * wave, campaign_wave=wave,
            treatment=treatment, converted=converted, conversion_value=value,
            reward_cost=5.0 if converted and kind != "informational" else 0.0,
            age=None if missing else 20 + i % 50, gender="unknown" if missing else "MF"[i % 2],
            credit_card_limit=None if missing else 1000.0 + i, identity_missing=int(missing), tenure_days=i % 700,
            hist_spend_total=spend, hist_txn_count=int(spend / 5), hist_avg_ticket=spend / 7,
            hist_recency_days=None if i % 5 == 0 else rng.uniform(0, 9), hist_view_rate=views,
            hist_time_view_to_conv=None if i % 3 else 1.5, discount_value=5.0, min_value=10.0, duration=7.0, n_channels=3)
        rows.append(tuple(record[f.name] for f in PROCESSED_SCHEMA.fields))
    return spark.createDataFrame(rows, PROCESSED_SCHEMA)
