"""What has to hold in a process of its own."""

import subprocess
import sys

CODE = """
from sieverank import get_session
from sieverank.operators import predicates
spark = get_session("fresh", spark__master="local[1]", spark__ui__enabled="false")
rows = spark.createDataFrame([(0,), (1,)], "id int")
print(predicates.condition_errors(rows, ["id >", "nothing = 1"], ["id"]))
try:
    rows.selectExpr("1 / id").collect()
except Exception as error:
    print("SEEN", type(error).__name__, str(error)[:40])
"""


def test_errors_of_spark_come_through():
    done = subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, timeout=300)
    assert "SEEN ArithmeticException [DIVIDE_BY_ZERO]" in done.stdout, done.stdout + done.stderr[-2000:]
