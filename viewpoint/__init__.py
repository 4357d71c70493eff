"""viewpoint: Spark-native evaluation of perspective summaries.

Functions map DataFrame -> DataFrame or Column -> Column. Nothing in the
package collects data to the driver; model inference stays outside and its
outputs arrive as tables.
"""

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
