"""quillon: a PySpark-native engine for detecting, masking, shaping and measuring text and conversation data."""
