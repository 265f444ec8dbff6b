"""paygrid: payroll scenarios, market comparison and document retrieval as Spark plans.

Every operator takes and returns DataFrames; nothing is collected inside an
operator except scalars and inputs with a checked size bound.
"""

__version__ = "0.1.0"
