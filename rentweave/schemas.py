"""Table schemas of the registry."""

from __future__ import annotations

RAW_LISTINGS = """
    raw_id string, source string, source_url string, source_listing_id string,
    fetched_at timestamp_ntz, http_status int, raw_content string,
    extracted_json string, parse_version string"""

LISTINGS = """
    listing_id string, raw_id string, source string, source_url string, title string,
    description string, address string, unit string, neighborhood string, borough string,
    lat double, lng double, rent_gross int, rent_net int, bedrooms double, bathrooms double,
    broker_fee boolean, lease_term_months int, move_in_notes string, pet_policy string,
    laundry string, elevator boolean, doorman boolean, images array<string>,
    first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"""

UNITS = """
    unit_id string, canonical_address string, canonical_unit string, neighborhood string,
    borough string, lat double, lng double, bedrooms double, bathrooms double,
    best_rent_gross int, best_rent_net int, broker_fee boolean, active_state string,
    last_seen_at timestamp_ntz, created_at timestamp_ntz"""

POSTINGS = "unit_id string, listing_id string, match_score double, created_at timestamp_ntz"

CHANGE_LOG = """
    unit_id string, listing_id string, kind string, field string, old_value string,
    new_value string, payload string, created_at timestamp_ntz"""

CRAWL_JOBS = """
    job_id string, source string, mode string, query string, status string, target_count bigint,
    discovered bigint, ingested bigint, units_added bigint,
    created_at timestamp_ntz, updated_at timestamp_ntz"""

ROUND_STATS = """
    starting_units bigint, discovered bigint, new_urls bigint, ingested bigint, errors bigint,
    units_added bigint, ending_units bigint"""

SAVED_SEARCHES = """
    search_id string, name string, prompt string, max_rent int, min_beds double, borough string,
    neighborhood string, no_fee_preferred boolean, is_active boolean, created_at timestamp_ntz"""

PAGES = "url string, http_status int, html string, fetched_at timestamp_ntz"

PAGE_META = """
    url string, title string, og_title string, og_images array<string>,
    geo_position string, icbm string"""

# Fields a source parser fills; the merge adds ids and times.
PARSED_FIELDS = (
    "title", "description", "address", "unit", "neighborhood", "borough", "lat", "lng",
    "rent_gross", "rent_net", "bedrooms", "bathrooms", "broker_fee", "lease_term_months",
    "move_in_notes", "pet_policy", "laundry", "elevator", "doorman", "images",
)


def column_types(ddl: str) -> dict[str, str]:
    """Column name -> type of one of the schemas above."""
    pairs = (item.split(None, 1) for item in " ".join(ddl.split()).split(", "))
    return {name: dtype for name, dtype in pairs}
