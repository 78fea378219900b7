"""The 35 gate queries: 20 read columns that injection touches, 15 do not.

Fixed values: the queries, their ids, thresholds, filters and result names are a given suite, stated plainly and in its order. Column
names follow our tables, and ties in an order are broken by the group.
"""

from plumbline.operators.gates import GateQuery

P, C = "payroll", "credit"


def _q(qid, dataset, columns, name, measure, over="", digits=None, **more):
    return GateQuery(qid, dataset, "targeted" if qid.startswith("T") else "control", tuple(columns.split()), name, measure, tuple(over.split()), digits, **more)


GATE_QUERIES = [
    _q("T01", P, "total_ot_paid", "total_ot", "sum", "total_ot_paid", 2),
    _q("T02", P, "total_ot_paid regular_hours", "n", "count", where="total_ot_paid > 0 AND regular_hours = 0"),
    _q("T03", P, "regular_gross_paid", "avg_gross", "avg", "regular_gross_paid", 2),
    _q("T04", P, "regular_gross_paid", "n", "count", where="regular_gross_paid > 200000"),
    _q("T05", P, "agency_name total_ot_paid", "agency_ot", "sum", "total_ot_paid", 2, by="agency_name", top=5),
    _q("T06", P, "total_ot_paid regular_gross_paid", "ot_ratio", "ratio", "total_ot_paid regular_gross_paid", 4),
    _q("T07", P, "title_description regular_gross_paid", "avg_gp", "avg", "regular_gross_paid", 2, where="title_description ILIKE '%ANALYST%'", by="title_description", top=10),
    _q("T08", P, "title_description", "n_titles", "distinct", "title_description"),
    _q("T09", P, "regular_gross_paid", "p90", "percentile", "regular_gross_paid", 2, share=0.9),
    _q("T10", P, "agency_name total_ot_paid", "agency_ot", "sum", "total_ot_paid", by="agency_name", top=5, ranked=True),
    _q("T11", C, "education", "n", "count", by="education"),
    _q("T12", C, "education", "n_invalid", "count", where="education NOT IN (1, 2, 3, 4, 5, 6)"),
    _q("T13", C, "limit_bal", "avg_limit", "avg", "limit_bal", 2),
    _q("T14", C, "limit_bal", "n_outlier", "count", where="limit_bal > 500000"),
    _q("T15", C, "bill_amt1", "n_neg", "count", where="bill_amt1 < 0"),
    _q("T16", C, "bill_amt1", "sum_bill1", "sum", "bill_amt1"),
    _q("T17", C, "pay_0", "n_bad_pay", "count", where="pay_0 > 8"),
    _q("T18", C, "age", "avg_age", "avg", "age", 2),
    _q("T19", C, "age", "n_bad_age", "count", where="age < 18 OR age > 100"),
    _q("T20", C, "education limit_bal", "avg_lim", "avg", "limit_bal", 2, by="education"),
    _q("C01", P, "agency_name", "n_agencies", "distinct", "agency_name"),
    _q("C02", P, "work_location_borough", "n", "count", by="work_location_borough"),
    _q("C03", P, "pay_basis", "n", "count", by="pay_basis"),
    _q("C04", P, "regular_hours", "avg_hours", "avg", "regular_hours", 4),
    _q("C05", P, "total_other_pay", "total_other", "sum", "total_other_pay", 2),
    _q("C06", P, "ot_hours", "avg_ot_hrs", "avg", "ot_hours", 4),
    _q("C07", P, "leave_status", "n_active", "count", where="leave_status = 'ACTIVE'"),
    _q("C08", P, "agency_name regular_hours", "avg_hrs", "avg", "regular_hours", 4, by="agency_name", top=10, ranked=True),
    _q("C09", C, "sex", "n", "count", by="sex"),
    _q("C10", C, "marriage", "n", "count", by="marriage"),
    _q("C11", C, "bill_amt2", "avg_bill2", "avg", "bill_amt2", 2),
    _q("C12", C, "pay_amt1", "sum_pay1", "sum", "pay_amt1"),
    _q("C13", C, "default_next", "n", "count", by="default_next"),
    _q("C14", C, "pay_amt3", "avg_pay3", "avg", "pay_amt3", 2),
    _q("C15", C, "pay_2", "n_delin", "count", where="pay_2 >= 2"),
]
