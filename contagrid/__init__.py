"""Weekly case and contact indicators as Spark DataFrame operators."""
