"""Workbook folder source: hand-made .xlsx files (one sheet missing, one broken file)."""

import datetime as dt
import os
import tempfile

from staffline.sources.workbooks import read_workbooks, sheet_table, workbook_errors
from tests.xlsx import workbook


def test_folder_of_workbooks(spark):
    d = tempfile.mkdtemp(prefix="staffline-wb-")
    staff_rows = [[" Matricula ", "Nome", "departamento", "GENERO", "data de admissão", "data de desligamento",
                   "motivo de desligamento", "matricula do gestor"],
                  [1, "Ana", "TI", "Feminino", ("date", 36526), None, None, 9],
                  [2, "Rui", "RH", "M", "31/12/2020", "abc", "Dispensa", 9],
                  [3, "Eva", None, None, "", ("date", 36600), "Pedido", None]]
    perf_rows = [["matricula", "avaliação", "data de encerramento do ciclo"],
                 [1, "Excepcional", ("date", 36600)], [1, "Abaixo do esperado", ("date", 36700)]]
    with open(os.path.join(d, "a.xlsx"), "wb") as f:
        f.write(workbook({"empresa": [["nome empresa", "uf"], ["ACME", "SP"]], "colaboradores": staff_rows,
                          "performance": perf_rows}))
    with open(os.path.join(d, "b.xlsx"), "wb") as f:  # the performance sheet is missing
        f.write(workbook({"colaboradores": [["matricula", "nome"], [4, "Ivo"]]}))
    with open(os.path.join(d, "broken.xlsx"), "wb") as f:
        f.write(b"not a zip")
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("ignored: not a workbook")

    rows = read_workbooks(spark, d)
    errs = workbook_errors(rows).collect()
    assert len(errs) == 1 and errs[0]["path"].endswith("broken.xlsx")

    staff = {r["employee_id"]: r for r in sheet_table(rows, "staff").collect()}
    assert set(staff) == {"1", "2", "3", "4"}
    assert staff["1"]["hire_date"] == dt.datetime(2000, 1, 1) and staff["1"]["gender"] == "Feminino"
    assert staff["2"]["hire_date"] == dt.datetime(2020, 12, 31) and staff["2"]["exit_date"] is None
    assert staff["3"]["hire_date"] is None and staff["3"]["exit_date"] == dt.datetime(2000, 3, 15)
    assert staff["1"]["manager_id"] == "9" and staff["4"]["name"] == "Ivo"

    reviews = sheet_table(rows, "reviews").collect()
    assert len(reviews) == 2 and {r["rating"] for r in reviews} == {"Excepcional", "Abaixo do esperado"}
    company = sheet_table(rows, "company").collect()
    assert [(r["company"], r["state"]) for r in company] == [("ACME", "SP")]


def test_exit_type_header_decides_for_its_own_sheet(spark):
    """A sheet without the exit type column is read by the exit reason, whatever other sheets have."""
    from pyspark.sql import functions as F

    from staffline.functions.text import voluntary_flag

    head = ["matricula", "data de desligamento", "motivo de desligamento"]
    folder = tempfile.mkdtemp(prefix="staffline-types-")
    for name, rows in {"a": [head, [1, "2020-01-02", "Pedido de demissão"], [2, "2020-01-02", "Dispensa"]],
                       "b": [[*head, "tipo desligamento"], [3, "2020-01-02", "Pedido de demissão", None],
                             [4, "2020-01-02", None, "Voluntário"]]}.items():
        with open(os.path.join(folder, f"{name}.xlsx"), "wb") as f:
            f.write(workbook({"colaboradores": rows}))
    staff = sheet_table(read_workbooks(spark, folder), "staff")
    got = {r["employee_id"]: r["v"] for r in staff.withColumn("v", voluntary_flag(staff)).collect()}
    assert got == {"1": True, "2": False, "3": False, "4": True}
    assert {r["has_exit_type"] for r in staff.where(F.col("employee_id").isin("1", "2")).collect()} == {False}
