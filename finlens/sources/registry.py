"""Source registry (A10): which raw source plays which role, and how each
maps onto the canonical schema.  Mappings are declarations; the conform
operator turns them into one projection per source."""

from __future__ import annotations

from finlens.operators.conform import LOCATION_FIELDS, NULL, SourceSpec, date, number, text, year
from finlens.schema import LATITUDE_CANDIDATES, LONGITUDE_CANDIDATES

# --- fixed values: candidate column lists of each source layout -------------
DF_SOURCE = SourceSpec(
    name="development_finance",
    role="primary",
    finance_type="DF",
    rank=0,
    fields={
        "project_id": text(["AidData Record ID"]),
        "project_name": text(["Title"]),
        "sector": text(["Sector Name"]),
        "province": text(["Available ADM1 Level"]),
        "district": text(["Available ADM2 Level"]),
        "latitude": number(["Latitude", "Project Latitude", "Available Latitude", "Lat"], LATITUDE_CANDIDATES,
                           label="Latitude | Project Latitude | Available Latitude | Lat"),
        "longitude": number(["Longitude", "Project Longitude", "Available Longitude", "Lon", "Lng"],
                            LONGITUDE_CANDIDATES,
                            label="Longitude | Project Longitude | Available Longitude | Lon | Lng"),
        "status": text(["Status"]),
        "approval_date": date(["Commitment Date", "Commitment Date (MM/DD/YYYY)", "Original Commitment Date",
                               "Date of Commitment"], label="Commitment Date (nearest match)"),
        "construction_start_date": date(
            ["Actual Implementation Start Date", "Implementation Start Date", "Actual Construction Start Date",
             "Construction Start Date"],
            ["Planned Implementation Start Date", "Planned Construction Start Date", "Planned Start Date",
             "Expected Start Date"],
            label="Actual Implementation Start Date -> Planned Start Date",
            transform="parse_date_any_with_fallback"),
        "financial_close_date": date(["Financial Close Date", "Loan Signing Date"]),
        "operation_date": date(["Actual Completion Date", "Actual Project Completion Date"],
                               ["Planned Completion Date", "Expected Completion Date"],
                               label="Actual Completion Date -> Planned Completion Date",
                               transform="parse_date_any_with_fallback"),
        "committed_usd": number(["Adjusted Amount (Nominal USD)"], ["Amount (Nominal USD)"],
                                transform="coalesce_numeric(adjusted, amount)"),
        "disbursed_usd": number(["Disbursed Amount (Nominal USD)", "Disbursement Amount (Nominal USD)"],
                                transform="coalesce_numeric"),
        "year": year(["Commitment Year"]),
    },
)

TRACKER_SOURCE = SourceSpec(
    name="investment_tracker",
    role="primary",
    finance_type="FDI",
    rank=1,
    fields={
        "project_id": NULL,
        "project_name": text(["Transaction Party"], ["Investor/Contractor", "Investor", "Investor or Builder"],
                             transform="coalesce_string"),
        "sector": text(["Sector"]),
        **LOCATION_FIELDS,
        "committed_usd": number(["Quantity in Millions"], multipliers=(1_000_000.0,),
                                transform="numeric * 1_000_000"),
        "year": year(["Year"]),
    },
)

COUNTRY_SOURCE = SourceSpec(
    name="country_investments",
    role="primary",
    finance_type="FDI",
    rank=2,
    fields={
        "project_id": NULL,
        "project_name": text(["Investor or Builder", "Investor"], transform="coalesce_string"),
        "sector": text(["Sector"]),
        **LOCATION_FIELDS,
        "status": text(["Status"], transform="direct_if_present"),
        "committed_usd": number(["Amount_musd"], ["Amount"], multipliers=(1_000_000.0, 1.0),
                                transform="coalesce_numeric_with_scaling"),
        "year": year(["Year"]),
    },
)

ENRICHMENT_SOURCE = SourceSpec(
    name="project_details",
    role="enrichment",
    finance_type="DF",
    rank=9,
    fields={
        "project_id": text(["AidData Record ID", "project_id"], label="AidData Record ID", transform="direct_or_hash"),
        "project_name": text(["Title", "Project Name", "project_name"], label="Title | Project Name",
                             transform="coalesce_string"),
        "sector": text(["Sector Name", "Sector"], transform="coalesce_string"),
        "province": text(["Available ADM1 Level", "Province"], transform="coalesce_string"),
        "district": text(["Available ADM2 Level", "District"], transform="coalesce_string"),
        "latitude": number(["Latitude"]),
        "longitude": number(["Longitude"]),
        "status": text(["Status"]),
        "approval_date": date(["Commitment Date"], transform="parse_mmddyyyy_or_excel_serial"),
        "construction_start_date": date(["Implementation Start Date"], transform="parse_mmddyyyy_or_excel_serial"),
        "financial_close_date": date(["Financial Close Date"], transform="parse_mmddyyyy_or_excel_serial"),
        "operation_date": date(["Actual Completion Date"], transform="parse_mmddyyyy_or_excel_serial"),
        "committed_usd": number(["Adjusted Amount (Nominal USD)"], ["Amount (Nominal USD)"],
                                transform="coalesce_numeric(adjusted, amount)"),
        "disbursed_usd": number(["Disbursed Amount (Nominal USD)"]),
        "year": year(["Commitment Year", "Year"], transform="coalesce_numeric"),
    },
)

WIDE_SOURCE = SourceSpec(name="wide_yearly", role="excluded", generate_ids=False)
# -----------------------------------------------------------------------------

PRIMARY_SOURCES = [DF_SOURCE, TRACKER_SOURCE, COUNTRY_SOURCE]
ALL_SOURCES = PRIMARY_SOURCES + [ENRICHMENT_SOURCE, WIDE_SOURCE]

# fixture name of the raw stand-in for each registered source
FIXTURE_OF = {
    "development_finance": "raw_df_source",
    "investment_tracker": "raw_tracker_source",
    "country_investments": "raw_country_source",
    "project_details": "enrichment_source",
    "wide_yearly": "wide_yearly_source",
}
