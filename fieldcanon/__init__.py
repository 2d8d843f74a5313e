"""PySpark jobs that turn raw KYC/AML field content into closed sets of canonical labels."""
