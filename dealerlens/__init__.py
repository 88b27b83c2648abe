"""dealerlens: used-vehicle price analytics as Spark DataFrame jobs.

Every operator is a function from DataFrame(s) to a DataFrame. Heavy work
(cleaning, canonicalising model names, fitting encoders, training, scoring,
change-log application, quota audits) runs as Spark plans; the driver only
builds plans and, where a schema depends on data, reads small bounded
metadata such as a one-hot vocabulary.
"""

__version__ = "0.1.0"
