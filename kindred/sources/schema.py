"""Schemas of the record tables."""

from __future__ import annotations

from pyspark.sql.types import DateType, DecimalType, LongType, StringType, StructField, StructType


def strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


#: The columns of the pipe-separated contribution files, in order.
CONTRIBUTIONS = StructType(
    strings("CMTE_ID", "AMNDT_IND", "RPT_TP", "TRANSACTION_PGI", "IMAGE_NUM", "TRANSACTION_TP", "ENTITY_TP", "NAME", "CITY", "STATE", "ZIP_CODE", "EMPLOYER", "OCCUPATION", "TRANSACTION_DT")
    + [StructField("TRANSACTION_AMT", DecimalType(14, 2))]
    + strings("OTHER_ID", "TRAN_ID", "FILE_NUM", "MEMO_CD", "MEMO_TEXT", "SUB_ID")
)
CANDIDATE_CONTRIBUTIONS = StructType(CONTRIBUTIONS.fields[:16] + strings("CAND_ID") + CONTRIBUTIONS.fields[16:])
CANDIDATES = StructType(strings("CAND_ID", "CAND_NAME", "CAND_PTY_AFFILIATION", "CAND_ELECTION_YR", "CAND_OFFICE_ST", "CAND_OFFICE", "CAND_OFFICE_DISTRICT", "CAND_ICI", "CAND_STATUS", "CAND_PCC", "CAND_ST1", "CAND_ST2", "CAND_CITY", "CAND_ST", "CAND_ZIP"))
LINKAGE = StructType(strings("CAND_ID", "CAND_ELECTION_YR", "FEC_ELECTION_YR", "CMTE_ID", "CMTE_TP", "CMTE_DSGN", "LINKAGE_ID"))
COMMITTEES = StructType(strings("CMTE_ID", "CMTE_NM", "TRES_NM", "CMTE_ST1", "CMTE_ST2", "CMTE_CITY", "CMTE_ST", "CMTE_ZIP", "CMTE_DSGN", "CMTE_TP", "CMTE_PTY_AFFILIATION", "CMTE_FILING_FREQ", "ORG_TP", "CONNECTED_ORG_NM", "CAND_ID"))
ADDRESSES = StructType(strings("TRAN_ID", "CMTE_ID", "FIRST_NAME", "LAST_NAME", "FILE_NUMBER", "CONTRIBUTOR_CITY", "CONTRIBUTOR_STATE", "CONTRIBUTOR_ZIP", "CONTRIBUTOR_STREET_1", "CONTRIBUTOR_STREET_2"))
VOTERS = StructType(strings("personid", "first_name", "last_name", "reg_address_street1", "reg_address_city", "reg_address_state", "reg_address_zip5"))
NAME_FREQUENCIES = StructType(strings("personid") + [StructField("voters_in_zip5", LongType()), StructField("voters_in_state", LongType())])
DIRECTORS = StructType(strings("directorid", "Director Name", "employment_Company Name", "employment_Role"))
IDENTITIES = StructType([StructField("id", LongType()), *strings("identity")])
ADJACENCY = StructType([*strings("identity1", "identity2"), StructField("verdict", LongType())])
LINKED = StructType(strings("identity1", "identity2"))

TABLES = {
    "individual_contributions": CONTRIBUTIONS,
    "contributions_to_candidates": CANDIDATE_CONTRIBUTIONS,
    "candidate_master": CANDIDATES,
    "candidate_to_committee_linkage": LINKAGE,
    "committee_master": COMMITTEES,
    "contributor_addresses": ADDRESSES,
    "voter": VOTERS,
    "name_freq": NAME_FREQUENCIES,
    "directors": DIRECTORS,
}
DATE = DateType()
