"""Annotated-text engine on Spark: conversion, analytics and planning over document tables."""
