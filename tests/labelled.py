"""Small labelled inputs for the model tests."""

import random
from uuid import UUID

from gavel import constants as K

SENTENCES = {
    "PII": "My passport and date of birth went to the clerk",
    "financial": "Our invoice shows revenue and margin by month",
    "policy": "Staff must follow the retention rule at all times",
    "internal": "We met on the sprint and its open points",
    "public": "Read the launch news on our open site",
}


def access_log_rows(spark, n, seed):
    """A labelled log in which about one event in twelve is odd: at night, from an unknown
    device, on sensitive things."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        odd = rng.random() < 0.08
        user = rng.randrange(48)
        hour = rng.choice((1, 2, 3)) if odd else rng.randrange(8, 18)
        moment = f"2026-03-{1 + i * 27 // n:02d}T{hour:02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}+00:00"
        department = K.DEPARTMENTS[user % len(K.DEPARTMENTS)]
        kind = rng.choice(("PII", "financial")) if odd else rng.choice(K.CLASSES)
        rows.append(
            (
                i, str(UUID(int=rng.getrandbits(128))), moment, f"u{user}", "analyst", department,
                f"{department}-{kind.lower()}-001", kind, rng.choice(("bulk_download", "delete")) if odd else "read",
                f"198.51.100.{user}" if odd else f"10.1.0.{user}", f"unmanaged-{user}" if odd else f"managed-{user}", odd,
            )
        )
    names = "row bigint, event_id string, occurred_at string, user_id string, role string, department string, "
    names += "resource_id string, resource_class string, action string, source_ip string, device_id string, is_anomaly boolean"
    return spark.createDataFrame(rows, names)


def labelled_texts(spark, n):
    rng = random.Random(n)
    fill = ["then", "also", "as", "noted", "before", "with", "care"]
    rows = []
    for i in range(n):
        label = K.CLASSES[i % len(K.CLASSES)]
        words = SENTENCES[label].split() + rng.choices(fill, k=6)
        rng.shuffle(words)
        rows.append((i, f"doc-{i}", " ".join(words), label))
    return spark.createDataFrame(rows, "row bigint, document_id string, text string, label string")
