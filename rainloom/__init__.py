"""rainloom: precipitation analytics expressed as Spark DataFrame plans.

Observations are plain long tables (time, lat, lon, value) or (station, time, value).  Every operator
takes DataFrames and returns DataFrames; nothing here needs a driver-side copy of the data.
"""

__version__ = "0.1.0"
