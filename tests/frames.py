"""Literal frames shared by the tests."""

from datetime import datetime, timedelta

NOW = datetime(2024, 6, 1, 12, 0, 0)
MICRO = timedelta(microseconds=1)

EVENTS = ("event_id string, client_id string, event_timestamp timestamp_ntz, event_type string, channel string, "
          "device_type string, time_on_page int, touchpoint_value double, conversion_flag boolean")
CLIENTS = ("client_id string, age int, annual_income int, current_401k_balance double, years_to_retirement int, "
           "risk_tolerance string, investment_experience string, client_tenure_months int, assigned_advisor_id string, "
           "service_tier string, total_assets_under_management double")


def event(n, client="a", back=timedelta(), kind="web_visit", channel="Website", device="Desktop",
          seconds=None, value=None, converted=None, now=NOW):
    return (f"e{n}", client, now - back, kind, channel, device, seconds, value, converted)


def client(name="a", age=40, income=60000, balance=1000.0, tenure=24, tier="Basic", assets=30000.0,
           risk="Moderate", experience="Advanced"):
    return (name, age, income, balance, max(0, 65 - age) if age is not None else None, risk, experience,
            tenure, "ADV_1", tier, assets)


def days(n):
    return timedelta(days=n)
