"""Readers of workbook archives and diagram text, and writers."""
