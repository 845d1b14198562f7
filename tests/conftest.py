import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from healthwatch.session import get_spark  # noqa: E402

SF_SMOKE = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", app="healthwatch-tests", shuffle_partitions=4,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="hw-test-ckpt-")})
    yield s
    s.stop()


def event(**kw):
    """A normal 10-key vitals event; keyword overrides, None drops the key."""
    base = dict(event_id="e1", patient_id="PT-0001", ward="ICU", heart_rate=80.0, bp_systolic=120.0,
                bp_diastolic=80.0, spo2=98.0, temperature_c=36.8, respiratory_rate=16.0,
                timestamp="2024-01-01T00:00:00")
    base.update(kw)
    return base
